"""Connected components of a link table by large and small stars, each round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import stored


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether no larger end of a link (a > b) stands in another link: then every b is the smallest node of its component."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(e.select("b", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return ends.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node with the smallest node of its component, itself left out.

    `links` has two long columns a and b in any direction; a row with a = b or repeated rows do no harm.
    Minima are formed per task before the exchange, so a node with very many links is one small row.
    """
    e = stored(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(e):
        e = stored(_small(_large(e)), "stars")
    return e


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`components` of all links, from those of the links before (`roots`, as `components` gives them) and the links since.

    Only the roots that new links join are gone through, so a turn costs what is new.
    """
    to_root = [roots.select(F.col("a").alias(c), F.col("b").alias(f"{c}1")) for c in "ab"]
    links = links.join(to_root[0], "a", "left").join(to_root[1], "b", "left").select(F.coalesce("a1", "a").alias("a"), F.coalesce("b1", "b").alias("b"))
    new = components(links)
    if new.isEmpty():
        return roots
    moved = roots.join(new.select(F.col("a").alias("b"), F.col("b").alias("now")), "b", "left").select("a", F.coalesce("now", "b").alias("b"))
    return stored(moved.union(new), "roots")
