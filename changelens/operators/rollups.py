"""Totals over several groupings at once, and sketches that are kept by part and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.operators.scoring import type_counts, with_rates

#: log2 of the buckets of a distinct-count sketch, and the size of a quantile sketch.
COUNT_BITS, RANK_SIZE = 12, 400
#: Error bounds that hold with a probability of 99.7 % and 99 %: of a count relative to it, of a rank as a share of all rows.
COUNT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (COUNT_BITS / 2), 0.0133


def score_cube(df: DataFrame, predicted: str, truth: str, level_of: dict[str, str]) -> DataFrame:
    """Counters and rates by track and type, track and level, track, level, and in all; ``grouping`` tells which (bits: track, level, type).

    The counters of a track and type are added up first; grouping sets then expand these few rows, not the cases.
    """
    counts = type_counts(df, predicted, truth, "track")
    book = F.create_map(*[F.lit(x) for pair in level_of.items() for x in pair])
    counts = counts.withColumn("level", F.coalesce(F.try_element_at(book, F.col("type")), F.lit("")))
    sets = [["track", "level", "type"], ["track", "level"], ["track"], ["level"], []]
    total = counts.groupingSets([[F.col(c) for c in s] for s in sets], "track", "level", "type").agg(
        F.grouping_id().alias("grouping"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return with_rates(total)


def sketches(df: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """One row per part: the number of rows, a distinct-count sketch of ``distinct`` and a quantile sketch of ``value``.

    The states are small binaries of a fixed size; store them, and merge those of any parts later without reading the rows again.
    """
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.hll_sketch_agg(distinct, COUNT_BITS).alias("distinct"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), RANK_SIZE).alias("ranks"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """The sketches of several parts as one."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"))


def estimates(states: DataFrame, *quantiles: float) -> DataFrame:
    """The states as numbers: ``n_distinct`` and an estimate ``q<percent>`` for each quantile."""
    values = [F.kll_sketch_get_quantile_double("ranks", F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles]
    return states.select(*[c for c in states.columns if c not in ("distinct", "ranks")], F.hll_sketch_estimate("distinct").alias("n_distinct"), *values)
