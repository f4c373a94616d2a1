"""Ordered set operations on detections and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import labels as L
from changelens.functions.replies import first_by_key
from changelens.functions.text import _c, squeeze_type, strip


def _key(name: str) -> Column:
    return F.lower(strip(name))


def merge_types(lists) -> Column:
    """Ordered union of label lists; case, blanks and underscores do not make a label new."""
    return first_by_key(F.flatten(_c(lists)), squeeze_type)


def ordered_dedupe(df: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """First row per trimmed, lower-case name; blank names are dropped.

    ``min_by`` keeps one candidate per task and key before the exchange, so
    a name that fills a third of the table costs one row per task.
    """
    keyed = df.withColumn("_k", _key(name)).where("_k <> ''")
    rest = [c for c in df.columns if c not in by]
    first = keyed.groupBy(*by, "_k").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(*by, "r.*")


def append_new(first: DataFrame, second: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """Union in which the second side only adds names the first one does not have."""
    a, b = (d.withColumn("_side", F.lit(i)) for i, d in enumerate((first, second)))
    both = a.unionByName(b).withColumn("_at", F.struct("_side", order))
    return ordered_dedupe(both, by, name, "_at").drop("_at", "_side")


def collapse_compounds(types) -> Column:
    """Drop the parts of every compound label that is present."""
    out = _c(types)
    for compound, parts in L.COMPOUND_PARTS.items():
        out = F.when(F.array_contains(out, compound), F.array_except(out, F.array(*[F.lit(p) for p in parts]))).otherwise(out)
    return F.array_distinct(out)


def consensus(votes: DataFrame, calls: DataFrame) -> DataFrame:
    """Agreement over repeated calls.

    ``votes`` is ``(case_id, call, kind, ord, type, evidence)``, ``calls`` is
    ``(case_id, n_calls)``. A defined label needs every call and keeps the spelling
    of the first call; an undefined one needs at least half, rounded up.
    """
    keyed = votes.withColumn("_k", _key("type"))
    agg = keyed.groupBy("case_id", "kind", "_k").agg(
        F.count_distinct("call").alias("n_agree"), F.count("*").alias("n_votes"),
        F.min_by(F.struct("type", "evidence"), F.struct("call", "ord")).alias("first"),
        F.min(F.struct("call", "ord")).alias("at"))
    full = agg.join(calls, "case_id")
    need_all = (F.col("kind") == "defined") & (F.col("n_agree") == F.col("n_calls"))
    need_half = (F.col("kind") == "undefined") & (F.col("n_votes") >= F.floor((F.col("n_calls") + 1) / 2))
    return full.where(need_all | need_half).select(
        "case_id", "kind", "first.type", "first.evidence", "n_agree", "n_votes", F.col("at.call").alias("call"), F.col("at.ord").alias("ord"))
