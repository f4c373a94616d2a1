"""Token counts without ids.

1. Every task counts the pre-tokens of its texts; the counts meet in one aggregation: the distinct pre-tokens.
2. Each distinct pre-token is encoded once, for its number of pieces; the table is stored.
3. Per document, pre-token frequencies are joined to that table and summed. The most frequent
   pre-tokens (`known` at most, of SHORT bytes at most, so a bounded broadcast) are looked up where the document is; the rest
   are exchanged and joined with the stored table, so every pre-token counts.

Defined results: null and empty texts have no bytes and no tokens; repeated rows and repeated or null ids give a
row each; an empty table gives no rows; extra columns are not read. Special strings inside texts count as the library counts them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm.common import map_rows, stored
from changelens.llm.pretokens import Encoder, chunks

KNOWN = 200_000
SHORT = 64
HELD = 400_000


def pretoken_counts(docs: DataFrame) -> DataFrame:
    """pretoken (binary), freq over all texts. A task hands over its counts whenever it holds HELD pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            found = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["pretoken", "freq"])
            held.clear()
            return found

        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                held.update(chunks(t or b""))
            if len(held) > HELD:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "pretoken binary, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))


def piece_counts(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """The distinct pre-tokens with n_pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for b in batches:
            n = pa.array(map(len, encoder.encode(b.column("pretoken").to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("pretoken"), b.column("freq"), n], ["pretoken", "freq", "n_pieces"])

    return distinct.mapInArrow(run, "pretoken binary, freq long, n_pieces long")


def frequent(pieces: DataFrame, known: int) -> int:
    """The least frequency that at most `known` pre-tokens reach, found on a histogram of 16 steps for each doubling."""
    step = F.floor(F.log2("freq") * 16)
    total, least = 0, 2**62
    for r in pieces.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("freq").alias("low")).orderBy(F.desc("s")).collect():
        total += r.n
        if total > known:
            break
        least = r.low
    return least


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, known: int = KNOWN) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit`) for every document."""
    spark = docs.sparkSession
    pieces = stored(piece_counts(pretoken_counts(docs), tokenizer), "pieces")
    top = pieces.filter((F.col("freq") >= frequent(pieces, known)) & (F.octet_length("pretoken") <= SHORT)).select("pretoken", "n_pieces").toPandas()
    shared = spark.sparkContext.broadcast(dict(zip(map(bytes, top["pretoken"]), top["n_pieces"].tolist(), strict=True)))

    def make():
        lookup = shared.value

        def run(texts, batch):
            sums, names, times, ends = [], [], [], [0]
            for t in texts:
                total = 0
                for c, n in Counter(chunks(t)).items():
                    pieces = lookup.get(c)
                    if pieces is None:
                        names.append(c)
                        times.append(n)
                    else:
                        total += pieces * n
                sums.append(total)
                ends.append(len(names))
            rest = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int64())], ["pretoken", "n"])
            return [batch.column("doc_id"), [len(t) for t in texts], sums, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)]

        return run

    rest = T.ArrayType(T.StructType([T.StructField("pretoken", T.BinaryType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("rest", rest)])
    part = stored(map_rows(docs.select("doc_id", "text"), make, schema).withColumn("row_no", F.monotonically_increasing_id()), "frequencies")
    open_ = part.select("row_no", F.explode("rest").alias("r")).select("row_no", "r.pretoken", "r.n")
    more = open_.join(pieces.select("pretoken", "n_pieces"), "pretoken").groupBy("row_no").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("n_more"))
    total = F.col("n_known") + F.coalesce("n_more", F.lit(0))
    return part.drop("rest").join(more, "row_no", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
