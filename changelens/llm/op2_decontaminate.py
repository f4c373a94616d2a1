"""Benchmark decontamination by greedy string tiling.

Test items are the stated query set: they are broadcast in blocks of about BLOCK_WORDS words (one block
unless the benchmark is larger), and documents are read once for each block, without any exchange.

In a task, a document's words become numbers, and a rolling Karp-Rabin hash of every SEED words is joined
with the seeds of the block's items. The longest match that is still free is marked as a tile in item and document, again and
again, until no free match of SEED words remains. Where seeds are few, those that follow one another on a diagonal form the
matches, and what a tile leaves of the others is put back; where words repeat and pairs of seeds would be many, the
longest free match is found by Karp-Rabin hashes of longer windows, in memory linear in text and item. Both
give the same tiles. Coverage is the tiled share of the item's words. Tiles may
stand in any order, so a passage whose sentences were moved about is still covered. An item whose
shared seeds cannot reach the threshold is passed over, which loses none.

Words are runs of letters and digits of the lower-cased text. Defined results: null and empty texts share
nothing; an item with fewer than SEED words is never found; repeated items are reported each; repeated or
null ids are reported as they are; empty tables give no rows; extra columns pass through `clean`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm.common import BATCH_BYTES, map_rows, packed, spark_arrow

SEED = 4
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
#: Pairs of equal seeds held for each word of text and item.
PAIRS = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def words(text: bytes) -> list[bytes]:
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_FOLD).split()


def rolling(ids: np.ndarray, width: int = SEED) -> np.ndarray:
    """Karp-Rabin hashes of all windows; a window with an unknown word (-1) hashes to 0."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    value = ids.astype(np.uint64) + np.uint64(2)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(width):
        out = out * _BASE + value[k : n + k]
        known &= ids[k : n + k] >= 0
    return np.where(known, np.maximum(out, np.uint64(1)), np.uint64(0))


class Block:
    """A block of items: their words as numbers and their seeds in hash order."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.number: dict[bytes, int] = {}
        self.items = []
        for item_id, text in items:
            self.items.append((item_id, np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int64)))
        hashes = [rolling(ids) for _, ids in self.items]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.seeds & np.uint64((1 << 20) - 1)] = True

    def seeded(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of the items' seeds that are among the hashes `h` of a document."""
        found = np.unique(h[self.maybe[h & np.uint64((1 << 20) - 1)] & (h != 0)])
        low, high = np.searchsorted(self.seeds, found, "left"), np.searchsorted(self.seeds, found, "right")
        n = high - low
        take = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.item[take], self.place[take]


def seed_pairs(own: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(place in item, place in document) of equal seeds, or None if there are more than PAIRS for each word of both."""
    mine = rolling(own)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    low, high = np.searchsorted(ranked, mine, "left"), np.searchsorted(ranked, mine, "right")
    n = np.where(mine != 0, high - low, 0)
    if n.sum() > PAIRS * (len(own) + len(h) + SEED):
        return None
    take = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(np.arange(len(mine)), n), order[take]


def matches(item: np.ndarray, doc: np.ndarray, place: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal matches (length, item place, document place) from the seeds of one item, verified word by word."""
    order = np.lexsort((place, at - place))
    place, at = place[order], at[order]
    cut = np.flatnonzero((np.diff(at - place) != 0) | (np.diff(place) != 1)) + 1
    out = []
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
        p, d, n = int(place[i]), int(at[i]), j - i + SEED - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], item[p : p + n] == doc[d : d + n], [False]]).astype(np.int8)))
        out += [(b - a, p + a, d + a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= SEED]
    return out


def tiles(found: list[tuple[int, int, int]], n_item: int, n_doc: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: longest first (ties: earlier in the item, then in the document), never overlapping on either side."""
    heap = [(-n, p, d) for n, p, d in found]
    heapq.heapify(heap)
    mine, theirs, out = np.zeros(n_item, bool), np.zeros(n_doc, bool), []
    while heap:
        n, p, d = heapq.heappop(heap)
        taken = mine[p : p - n] | theirs[d : d - n]
        if not taken.any():
            mine[p : p - n], theirs[d : d - n] = True, True
            out.append((-n, p, d))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]]).astype(np.int8)))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i >= SEED:
                heapq.heappush(heap, (i - j, p + i, d + i))
    return out


def free_windows(ids: np.ndarray, taken: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of `width` words without a taken or unknown one, from prefix hashes."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocked = np.concatenate([[0], np.cumsum(taken | (ids < 0))])
    at = np.flatnonzero(blocked[width:] == blocked[:n])
    # windows by halves: the hash of 2k words comes from those of k
    h, size = ids.astype(np.uint64) + np.uint64(2), 1
    base = _BASE
    with np.errstate(over="ignore"):
        parts, offset, rest = np.zeros(n, np.uint64), 0, width
        while rest:
            if rest & 1:
                parts = parts * base + h[offset : offset + n]
                offset += size
            rest >>= 1
            if rest:
                h = h[:-size] * base + h[size:]
                h ^= h >> np.uint64(29)
                base, size = base * base, size * 2
    return parts[at], at


def long_tiles(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """The same tiles as of all matches, by hashes of whole windows: no pairs of seeds are held.

    The longest width with an equal free window is found by bisection (a free match holds shorter ones); all tiles
    of that width are marked from the item's first place on, each at the document's first place, then the width shrinks.
    """
    mine, theirs, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []

    def both(width: int) -> bool:
        return len(np.intersect1d(free_windows(item, mine, width)[0], free_windows(doc, theirs, width)[0])) > 0

    most = min(len(item), len(doc))
    while most >= SEED:
        low, high = SEED - 1, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if both(mid) else (low, mid - 1)
        if low < SEED:
            break
        h, at = free_windows(doc, theirs, low)
        order = np.argsort(h, kind="stable")
        ranked, places = h[order], at[order]
        next_of: dict[int, int] = {}
        for x, p in zip(*(a.tolist() for a in free_windows(item, mine, low)), strict=True):
            if mine[p : p + low].any():
                continue
            i = next_of.get(x, int(np.searchsorted(ranked, np.uint64(x), "left")))
            while i < len(ranked) and ranked[i] == x:
                d = int(places[i])
                if theirs[d : d + low].any():
                    i += 1
                    continue
                if not np.array_equal(item[p : p + low], doc[d : d + low]):
                    i += 1
                    continue
                mine[p : p + low], theirs[d : d + low] = True, True
                out.append((low, p, d))
                break
            next_of[x] = i
        most = low - 1
    return out


def compare(block: Block, text: bytes, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(item_id, words of the item, tiled words, tiles, longest tile) of each item that the text covers."""
    found = words(text)
    ids = np.fromiter(map(block.number.get, found, repeat(-1)), np.int64, len(found))
    h = rolling(ids)
    item, place = block.seeded(h)
    out = []
    if len(item):
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        cut = np.flatnonzero(np.diff(item)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(item)], strict=True):
            item_id, own = block.items[item[i]]
            seeded = np.zeros(len(own), bool)
            for k in range(SEED):
                seeded[place[i:j] + k] = True
            if seeded.sum() >= coverage * len(own):
                pairs = seed_pairs(own, h)
                got = long_tiles(own, ids) if pairs is None else tiles(matches(own, ids, *pairs), len(own), len(ids))
                n = sum(t[0] for t in got)
                if n >= coverage * len(own):
                    out.append((item_id, len(own), n, len(got), max(t[0] for t in got)))
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator:
    """The items as broadcast blocks of about `block_words` words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id"), F.col("text").cast("binary").alias("t")).filter("t IS NOT NULL")
    n = -(-int(items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // (8 * block_words))
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "t"), F.lit(n)) == i).collect()
        yield spark.sparkContext.broadcast([(r.item_id, bytes(r.t)) for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_item_words, n_tiled, n_tiles, longest, coverage of every document and item at or above `coverage`."""
    out = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *(T.StructField(c, T.LongType()) for c in ("n_item_words", "n_tiled", "n_tiles", "longest"))])

    def over(items):
        def make():
            block = Block(items.value)

            def run(texts, batch):
                ids, rows = batch.column("doc_id").to_pylist(), []
                for i, t in zip(ids, texts, strict=True):
                    rows += [(i, *x) for x in compare(block, t, coverage)]
                return list(map(list, zip(*rows, strict=True))) or [[]] * 6

            return run

        return map_rows(docs.select("doc_id", "text"), make, out)

    found = docs.sparkSession.createDataFrame([], out)
    for items in blocks(benchmark, block_words):
        found = found.union(over(items))
    return found.withColumn("coverage", F.col("n_tiled") / F.col("n_item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that cover no item, with all their columns; rows stay where they are."""

    def over(df, items):
        inner = packed(df, text=F.col("text"))
        arrow = spark_arrow(df.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(items.value)
            for b in batches:
                keep = [not compare(block, t or b"", coverage) for t in b.column("text").cast(pa.binary()).to_pylist()]
                row = b.column("row").filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays(row.flatten(), schema=arrow)

        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return inner.mapInArrow(run, df.schema)

    for items in blocks(benchmark, block_words):
        docs = over(docs, items)
    return docs
