"""Turn array columns into rows, and bind a value inside an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression that is repeated inside a lambda is evaluated again for every
    element; binding it keeps such expressions linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pos_rows(df: DataFrame, array, *keep, names=("pos", "x")) -> DataFrame:
    """One row per element with its position; empty arrays give no row.

    The outer form is used on purpose: for the plain one the optimizer adds a
    filter on the size of the array, which computes the whole array a second
    time, below any exchange.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(*names)).where(F.col(names[0]).isNotNull())


def rows(df: DataFrame, array, *keep, name="x") -> DataFrame:
    return pos_rows(df, array, *keep, names=("_pos", name)).drop("_pos")


def inline_rows(df: DataFrame, array, *keep) -> DataFrame:
    """One row per struct of the array, its fields as columns."""
    wide = rows(df, array, *keep, name="_x")
    return wide.select(*[c for c in wide.columns if c != "_x"], "_x.*")


#: Ids that several cases share, up to which they are sent to every task.
FEW_IDS = 100_000


def once_and_shared(cases: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Cases whose id stands once, and those that share one (none: None). Looks through the ids."""
    shared = cases.groupBy(F.col("case_id").alias("_id")).count().where("count > 1").select("_id")
    n = shared.limit(FEW_IDS + 1).count()
    if not n:
        return cases, None
    ids, same = F.broadcast(shared) if n <= FEW_IDS else shared, F.col("case_id").eqNullSafe(F.col("_id"))
    return cases.join(ids, same, "left_anti"), cases.join(ids, same, "left_semi")


def runs_of(items: Column, same) -> Column:
    """Neighbours for which ``same`` holds as one array each; linear in the items."""
    def cut(a: Column) -> Column:
        at = F.transform(a, lambda x, i: F.when((i == 0) | ~same(F.get(a, i - 1), x), i))
        return let(F.array_compact(at), lambda starts: F.transform(starts, lambda s, j: F.slice(
            a, s + 1, F.coalesce(F.get(starts, j + 1), F.size(a)) - s)))

    return let(items, cut)
