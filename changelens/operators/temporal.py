"""Joins over time: the latest row before a moment, and the intervals that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT = 16  # bins of one width that an interval may touch, about; a wider interval uses bins that many times wider
WIDTHS = 8  # widths in use: the widest bin holds SPLIT ** (WIDTHS - 1) of the narrowest


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Every left row with the latest row of ``right`` at or before it, as a struct ``match`` (null: none).

    Both sides are put in one order by key and time and the last right row is carried along. Work is cut
    into buckets of ``bucket_seconds``, so a key with most rows is many tasks; what a bucket hands to the ones after it
    is one row, its last right row, so the carry across buckets ranks a row per key and bucket only. Rows without a
    key or a time match nothing. ``right`` has one row for a key and time.
    """
    names = [c for c in right.columns if c not in by]
    payload = F.struct(*names)
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000))
    rows = left.withColumn("_left", F.struct(*left.columns)).select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), "_left", F.lit(None).cast(_type(right, payload)).alias("_right"))
    known = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, on]))
    both = rows.union(known.select(*by, F.col(on).alias("_t"), F.lit(0), F.lit(None).cast(_type(rows, F.col("_left"))), payload))
    both = both.withColumn("_b", bucket("_t"))
    inside = Window.partitionBy(*by, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_right", ignorenulls=True).over(inside)).where("_side = 1").select(*by, "_b", "_left", "_last")
    ends = known.select(*by, bucket(on).alias("_b"), F.col(on).alias("_t"), payload.alias("_right")).groupBy(*by, "_b").agg(F.max_by("_right", "_t").alias("_end"))
    asked = seen.where("_last IS NULL").select(*by, "_b").distinct()
    before = Window.partitionBy(*by).orderBy("_b", "_asks").rowsBetween(Window.unboundedPreceding, -1)
    marks = ends.select(*by, "_b", F.lit(1).alias("_asks"), "_end").union(asked.select(*by, "_b", F.lit(0), F.lit(None).cast(_type(ends, F.col("_end")))))
    carried = marks.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_asks = 0").select(*by, "_b", "_carried")
    found = seen.join(carried, [*by, "_b"], "left")
    return found.select("_left.*", F.coalesce("_last", "_carried").alias("match"))


def _type(df: DataFrame, column: Column):
    return df.select(column.alias("_")).schema[0].dataType


def in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with every interval of their key that holds them: ``start <= at < end`` over whole numbers.

    An interval is split over bins: of the widths ``width * SPLIT ** n`` the first is taken in which it
    touches about SPLIT bins at most, so a long interval is no longer than a short one. A point has one bin of every
    width in use. They meet by key, width and bin in an equality join, which Spark can split when one key is
    hot, and each pair meets once.
    """
    span = F.greatest(F.col(end) - F.col(start), F.lit(1))
    level = F.lit(WIDTHS - 1)
    for n in range(WIDTHS - 2, -1, -1):
        level = F.when(span <= width * SPLIT ** (n + 1), n).otherwise(level)
    size = F.element_at(F.array(*[F.lit(width * SPLIT**n).cast("bigint") for n in range(WIDTHS)]), F.col("_w") + 1)
    floor = lambda c: F.floor(F.col(c) / size)
    some = intervals.where(F.col(start) < F.col(end)).withColumn("_w", level)
    some = some.withColumn("_bin", F.explode(F.sequence(floor(start), F.floor((F.col(end) - 1) / size))))
    widths = F.sequence(F.lit(0), F.lit(WIDTHS - 1))
    all_ = points.where(F.col(at).isNotNull()).withColumn("_w", F.explode(widths)).withColumn("_bin", floor(at))
    used = some.select("_w").distinct()  # WIDTHS rows at most
    met = all_.join(F.broadcast(used), "_w", "left_semi").join(some, [*by, "_w", "_bin"])
    return met.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_w", "_bin")
