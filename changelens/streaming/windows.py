"""Event-time windows over a stream of rows: tumbling, sliding, session, and rows that come too late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, by: str, window: Column, late: str, *aggregates: Column) -> DataFrame:
    """Aggregates by key and window. ``late`` is how long a window stays open behind the newest row; its state is dropped then."""
    found = stream.withWatermark(time, late).groupBy(window.alias("w"), F.col(by)).agg(*aggregates)
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in ("w", by)])


def tumbling(time: str, size: str) -> Column:
    return F.window(time, size)


def sliding(time: str, size: str, step: str) -> Column:
    return F.window(time, size, step)


def session(time: str, gap: str) -> Column:
    return F.session_window(time, gap)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Run a stream over all that is there now and write its rows as Parquet; returns the progress of its batches.

    In ``append`` mode a window is written once, when the watermark has passed it: the newest stay open. In ``complete`` mode
    the table holds all windows as of the last batch. A batch that is repeated after a failure replaces its own rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.json for p in query.recentProgress]


def read_stream(spark: SparkSession, path: str, schema, prepare: Callable[[DataFrame], DataFrame] | None = None, max_files: int = 64) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream in batches of files."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(pattern)
    return prepare(rows) if prepare else rows
