"""Helpers shared by the training-data operators: shared folder, stored steps, row keys, Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.plans.session import checkpoint_dir

#: Rows with one text of a task at once: bounds what Python holds, whatever the texts' lengths.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only in local mode (tests), elsewhere it has to be set."""
    return checkpoint_dir(spark).rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def release(spark: SparkSession) -> int:
    """Delete all that this process stored in the shared folder; returns how many paths there were.

    For callers who have written their results: frames made before read the stored steps and fail afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_MADE)
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step as a table in the shared folder and read it back: it runs once, lost executors or not."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as column `row` beside the operator's own columns, so that no names can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def key(text: str = "text") -> list[Column]:
    """Two longs that tell rows apart: the id (null: the smallest long) and a hash of id and text.

    Rows equal in id and text share them and are treated alike.
    """
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64("doc_id", text).alias("k2")]


def map_rows(df: DataFrame, make: Callable[[], Callable[[list, pa.RecordBatch], list]], schema: T.StructType | str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run a function over Arrow batches of a table whose `text` column it gets as a list of bytes (null: empty).

    `make` is called once in each task and returns the function; that returns the output columns in order.
    A batch holds about `batch_bytes`, as do those of the steps that are run before the next call.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = spark_arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            columns = f(texts, b)
            if columns is not None:
                arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)


def spark_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
