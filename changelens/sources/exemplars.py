"""Exemplar pools and embedding matrices."""

from __future__ import annotations

import io
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens import schemas
from changelens.sources.paths import exists

_POOL = schemas.EXEMPLAR.removeprefix("struct<").removesuffix(">")
_POOL_FIELDS = [f.split(":")[0] for f in _POOL.split(",")]


def _last_wins(df: DataFrame, order: list) -> DataFrame:
    """Last record per id; records without an id are dropped."""
    rest = [c for c in df.columns if c not in ("_o", "id")]
    kept = df.where(F.col("id").isNotNull()).withColumn("_o", F.struct(*order))
    return kept.groupBy("id").agg(F.max_by(F.struct(*rest), "_o").alias("r")).select("id", "r.*").drop("_file", "_pos")


def read_pool_json(spark: SparkSession, folder: str) -> DataFrame:
    """``java_records_*.json`` files, each with a ``records`` array; later file names win."""
    raw = (spark.read.schema(f"records array<{schemas.EXEMPLAR}>").option("multiLine", True)
           .option("pathGlobFilter", "java_records_*.json").json(folder)
           .select("records", F.col("_metadata.file_name").alias("_file")))
    rows = raw.select("_file", F.posexplode("records").alias("_pos", "r")).select("_file", "_pos", "r.*")
    return _last_wins(rows, ["_file", "_pos"])


class _PlainUnpickler(pickle.Unpickler):
    """Accepts containers, strings and numbers only."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a record pool")


def read_pool_pickle(spark: SparkSession, path: str) -> DataFrame:
    """Pickled lists of records, one task per file: split large pools into many files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    ddl = ", ".join(f.replace(":", " ", 1) for f in _POOL.split(","))

    def load(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                records = _PlainUnpickler(io.BytesIO(r.content)).load()
                rows = [(r.path, i, *(rec.get(f) for f in _POOL_FIELDS)) for i, rec in enumerate(records)]
                yield pd.DataFrame(rows, columns=["_file", "_pos", *_POOL_FIELDS])

    return _last_wins(files.mapInPandas(load, f"_file string, _pos bigint, {ddl}"), ["_file", "_pos"])


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 65536) -> DataFrame:
    """A ``.npy`` matrix on shared storage as ``(row_id, embedding)``.

    Only the header is read here; each task maps the file and reads its own rows.
    """
    n = np.load(path, mmap_mode="r").shape[0]
    starts = spark.range(0, n, rows_per_task, numPartitions=max(1, -(-n // rows_per_task)))

    def load(batches):
        data = np.load(path, mmap_mode="r")
        for b in batches:
            for start in b.column("id").to_pylist():
                part = np.asarray(data[start:start + rows_per_task], dtype=np.float32)
                offsets = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(start, start + len(part), dtype=np.int64)),
                     pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=["row_id", "embedding"])

    return starts.mapInArrow(load, "row_id bigint, embedding array<float>")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """``{ids, labels}`` of a matrix as ``(row_id, id, label)``."""
    raw = spark.read.schema("ids array<string>, labels array<string>").option("multiLine", True).json(path)
    return raw.select(F.posexplode(F.arrays_zip("ids", "labels")).alias("row_id", "m")).select(
        F.col("row_id").cast("bigint").alias("row_id"), F.col("m.ids").alias("id"), F.col("m.labels").alias("label"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of urls, aligned to matrix rows, as ``(row_id, url)``; the last row of a url wins."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("urls"))
    rows = raw.select(F.posexplode("urls").alias("row_id", "url"))
    return rows.groupBy("url").agg(F.max("row_id").cast("bigint").alias("row_id"))


def query_channels(urls: DataFrame, *channels: DataFrame) -> DataFrame:
    """``(url, channel_0, channel_1, ...)``: the aligned matrices of each query url."""
    out = urls
    for i, c in enumerate(channels):
        out = out.join(c.withColumnRenamed("embedding", f"channel_{i}"), "row_id")
    return out.drop("row_id")


def read_trophies(spark: SparkSession, records: str, matrix: str) -> DataFrame:
    """Successful cases with their vectors; empty when either file is missing.

    Records are numbered in file order through their file offset rank.
    """
    schema = "row_id bigint, url string, ground_truth array<string>, diff_snippet string, embedding array<float>"
    if not (exists(spark, records) and exists(spark, matrix)):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(records).where(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id())
    parts = lines.withColumn("_p", F.spark_partition_id())
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    # the low 33 bits of the generated id count the rows of a partition before the filter
    inner = Window.partitionBy("_p").orderBy("_id")
    numbered = parts.withColumn("_i", F.row_number().over(inner) - 1).join(F.broadcast(offsets), "_p")
    rec = numbered.select((F.col("_o") + F.col("_i")).alias("row_id"), F.from_json(
        "value", "url string, ground_truth array<string>, diff_snippet string").alias("r")).select("row_id", "r.*")
    return rec.join(read_npy(spark, matrix), "row_id")
