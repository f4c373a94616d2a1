"""Ranked lexical search, reversed: the index is over the asked items, and the documents are streamed through it.

The items are the stated query set. An inverted index over their terms (term -> items and how often each asks for it) is broadcast,
in blocks of about BLOCK_BYTES of items; every document's counts of the indexed terms go through it, and each
item keeps a heap of its TOP best documents so far. A task hands over its heaps, at most TOP rows for each item, and
these are merged by rank. Neither documents nor their terms are exchanged.

The texts are read twice: once for the corpus counts behind the weights (documents, terms, documents by indexed term), once
for the scores. Both passes cut a text into pieces, so a very long one costs memory only for its distinct terms.

Defined results: null and empty texts, and items without a term that some document holds, give no rows; a term that an item
repeats counts as often; equal scores are ordered by id (null last), rows equal in id and score by nothing else, which leaves the same
result; repeated items are ranked each; fewer than TOP documents above score 0 give fewer rows; empty tables
give no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm.common import BATCH_BYTES

TOP = 10
BLOCK_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
#: Scores held at once: documents of a step times items.
CELLS = 1 << 21
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_LAST = np.iinfo(np.int64).max


def term_counts(text: bytes) -> Counter:
    """How often each term occurs: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):  # up to the end of a term
            folded = text[at:end].translate(_FOLD)
            cut = folded.rfind(b" ")
            while cut < 0 and end < len(text):
                end += PIECE_BYTES
                folded = text[at:end].translate(_FOLD)
                cut = folded.rfind(b" ")
            if end < len(text):
                folded, end = folded[: cut + 1], at + cut + 1
        else:
            folded = text[at:end].translate(_FOLD)
        out.update(folded.split())
        at = end
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Index:
    """An inverted index over a block of items."""

    def __init__(self, items: list[bytes]):
        asked = [term_counts(t) for t in items]
        self.number = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
        posts: list[list[tuple[int, int]]] = [[] for _ in self.number]
        for i, terms in enumerate(asked):
            for t, n in terms.items():
                posts[self.number[t]].append((i, n))
        self.n_items = len(items)
        self.ends = np.cumsum([0, *map(len, posts)])
        self.item = np.array([i for p in posts for i, _ in p], np.int64)
        self.times = np.array([n for p in posts for _, n in p], np.int64)

    def entries(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of the text, term and count of every indexed term in the texts, and the texts' lengths in terms."""
        doc, term, tf, lens = [], [], [], []
        for i, t in enumerate(texts):
            counts = term_counts(t)
            lens.append(counts.total())
            found = self.number.keys() & counts.keys() if len(counts) < len(self.number) else [x for x in self.number if x in counts]
            doc += [i] * len(found)
            term += [self.number[x] for x in found]
            tf += [counts[x] for x in found]
        return np.array(doc, np.int64), np.array(term, np.int64), np.array(tf, np.int64), np.array(lens, np.int64)

    def scores(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int) -> np.ndarray:
        """Sums of the gains by document and item, in 64-bit integers."""
        lens = self.ends[term + 1] - self.ends[term]
        take = np.repeat(self.ends[term] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        out = np.zeros(n_docs * self.n_items, np.int64)
        np.add.at(out, np.repeat(doc, lens) * self.n_items + self.item[take], np.repeat(gain, lens) * self.times[take])
        return out.reshape(n_docs, self.n_items)


class Heaps:
    """The best `top` documents of every item: higher score first, then smaller id."""

    def __init__(self, n_items: int, top: int):
        self.top, self.held = top, [[] for _ in range(n_items)]
        self.score, self.id = np.zeros(n_items, np.int64), np.full(n_items, -1, np.int64)  # what a new document must beat

    def offer(self, ids: np.ndarray, scores: np.ndarray):
        better = (scores > self.score) | ((scores == self.score) & (ids[:, None] < self.id))
        for d, i in zip(*(x.tolist() for x in np.nonzero(better)), strict=True):
            heap, entry = self.held[i], (int(scores[d, i]), -int(ids[d]))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.score[i], self.id[i] = heap[0][0], -heap[0][1]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items with a text as lists of (item_id, bytes) of about `block_bytes`."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("t")).filter("t IS NOT NULL")
    n = -(-int(rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // block_bytes)
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "t"), F.lit(n)) == i).collect()
        if part:
            yield sorted(((r.item_id, bytes(r.t)) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def corpus_counts(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each indexed term; `index` is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        df, n_docs, n_terms = np.zeros(len(own.number), np.int64), 0, 0
        for b in batches:
            _, term, _, lens = own.entries([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            df += np.bincount(term, minlength=len(df))
            n_docs, n_terms = n_docs + int((lens > 0).sum()), n_terms + int(lens.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *seen.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[seen].tolist()], pa.int64())], ["term", "n"])

    total = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(index.value.number), np.int64)
    n_docs = n_terms = 0
    for r in total.toLocalIterator():  # a row for each term of the block
        if r.term >= 0:
            df[r.term] = r.n
        elif r.term == -2:
            n_docs = r.n
        else:
            n_terms = r.n
    return n_docs, n_terms, df


def _ranked_block(docs: DataFrame, block: list[tuple], top: int) -> DataFrame:
    """(item_no, score, doc_id) of the heaps of all tasks."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(Index([t for _, t in block]))
    n_docs, n_terms, df = corpus_counts(docs, index)
    weights = spark.sparkContext.broadcast(np.array([weight(n_docs, int(x)) for x in df], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = index.value, weights.value
        heaps, step = Heaps(own.n_items, top), max(1, CELLS // max(1, own.n_items))
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            for at in range(0, len(texts), step):
                part = texts[at : at + step]
                doc, term, tf, lens = own.entries(part)
                m = 25 + (75 * lens * n_docs) // max(1, n_terms)
                gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                heaps.offer(ids[at : at + step], own.scores(doc, term, gain, len(part)))
        found = [(i, s, None if -d == _LAST else -d) for i, heap in enumerate(heaps.held) for s, d in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item_no", "score", "doc_id"])

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select("doc_id", "text").mapInArrow(run, "item_no int, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the `top` best documents of every item."""
    spark = docs.sparkSession
    asked = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", asked), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, block_bytes):
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = _ranked_block(docs, block, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], T.StructType([T.StructField("item_no", T.IntegerType()), T.StructField("item_id", asked)]))
        out = out.union(best.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score"))  # the items of one block
    return out
