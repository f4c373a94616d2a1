"""Splits, samples and schedules.

Random order is the order of a seeded md5 of the key: the same on every cluster
size and engine. Ranks over a whole table come from counts per hash bucket, so
no task ever sorts everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.plans.session import stored

BUCKET_ROWS = 4096  # rows that one bucket of a rank holds on average, at most


def seeded_hash(seed: int, *keys) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def global_rank(df: DataFrame, hash_col: str, out: str = "rank") -> DataFrame:
    """Rank of every row by a uniform hash column, without a global sort.

    Counts per hash prefix give the offset of each bucket; rows are ranked
    inside their bucket only. The prefix grows with the table.
    """
    total = df.agg(F.count("*").alias("n"))
    digits = F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("_total") / BUCKET_ROWS))).cast("int")
    b = df.withColumn("_total", total.scalar()).withColumn("_b", F.left(F.col(hash_col), digits)).drop("_total")
    counts = b.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("_b").orderBy(hash_col)
    ranked = b.withColumn("_i", F.row_number().over(inner)).join(offsets, "_b")
    return ranked.withColumn(out, F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def group_split(df: DataFrame, group: str, val_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``part``: all rows of a group land in ``train`` or in ``val``."""
    groups = df.select(group).distinct().withColumn("_h", seeded_hash(seed, group))
    cut = groups.agg(F.greatest(F.lit(1), F.floor(F.count("*") * (1.0 - val_fraction))).alias("cut"))
    parts = global_rank(groups, "_h", "_r").withColumn("_cut", cut.scalar()).select(
        group, F.when(F.col("_r") <= F.col("_cut"), "train").otherwise("val").alias("part"))
    return df.join(parts, group)


def sample_per_type(df: DataFrame, n: int, key: str = "case_id", type_col: str = "type", seed: int = 42) -> DataFrame:
    """At most ``n`` cases per type, each case once, in seeded order.

    ``df`` is ``(key, type)``. The rank filter becomes a per-task limit before
    the exchange, so a dominant type sends ``n`` rows per task.
    """
    # repeated rows stand together in the order, so a dense rank counts each case once without an exchange before it
    w = Window.partitionBy(type_col).orderBy("_h", key)
    hashed = df.select(key, type_col).withColumn("_h", seeded_hash(seed, type_col, key))
    picked = hashed.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n).select(key).distinct()
    return global_rank(picked.withColumn("_h", seeded_hash(seed, key)), "_h", "pos").drop("_h")


def schedule_heads(df: DataFrame, n_per_type: int, done: DataFrame | None = None,
                   existing: DataFrame | None = None, seed: int = 42,
                   key: str = "case_id", type_col: str = "type") -> DataFrame:
    """The stretch of every type's list that a round-robin schedule can reach.

    A type skips a case only because an earlier pick took it, and there are at
    most ``n_types * n_per_type`` picks in all. So the first ``n_types * n_per_type``
    open cases of each list are enough for the exact schedule, however long the lists are.
    """
    open_cases = df.select(key, type_col).distinct()
    if done is not None:
        open_cases = open_cases.join(done.select(key).distinct(), key, "left_anti")
    n_types = df.select(type_col).distinct().count()
    w = Window.partitionBy(type_col).orderBy("_h", key)
    heads = open_cases.withColumn("_h", seeded_hash(seed, type_col, key)).withColumn(
        "pos", F.row_number().over(w)).where(F.col("pos") <= n_types * n_per_type)
    quota = F.lit(n_per_type)
    if existing is not None:
        counts = existing.select(type_col, F.col("n").alias("_done"))
        heads = heads.join(counts, type_col, "left")
        quota = F.greatest(F.lit(0), F.lit(n_per_type) - F.coalesce("_done", F.lit(0)))
    return heads.select(type_col, key, "pos", quota.alias("quota"))


def serial_choice(agents: DataFrame, lists: DataFrame, order: list[str], owner: str, key: str) -> DataFrame:
    """What agents choose who pick one after the other: each the first key of its owner's list that is still free.

    ``agents`` is ``(*order, pos)`` with ``owner`` among the ``order`` columns, which say who picks first; ``pos`` is the first place
    it looks at. ``lists`` is ``(owner, pos, key)``. Nobody waits: all agents ask at once, a key keeps the
    earliest of those who ask, and the others ask for the next key that no earlier agent holds. A key only ever passes to
    an earlier agent, so an agent that is refused never has to come back, and the end is the sequential choice.
    Every round is a stored table; the driver sees how many agents are left. Returns ``(*order, pos, key)``.
    """
    lists = stored(lists.select(owner, "pos", key))
    who = F.struct(*order)
    held = None
    asking = agents.join(lists, [owner, "pos"]).select(*order, "pos", key)
    while True:
        every = asking if held is None else held.union(asking)
        every = stored(every)
        held = stored(every.groupBy(key).agg(F.min_by(F.struct(*order, "pos"), who).alias("_h")).select("_h.*", key))
        refused = every.join(held, order, "left_anti")
        holders = held.select(F.col(key), who.alias("_holder"))
        more = refused.drop(key).withColumnRenamed("pos", "_pos").join(lists, owner).where("pos > _pos")
        free = more.join(holders, key, "left").where(F.col("_holder").isNull() | (F.col("_holder") > who))
        asking = stored(free.groupBy(*order).agg(F.min(F.struct("pos", key)).alias("_n")).select(*order, "_n.*"))
        if asking.isEmpty():
            return held


def round_robin(df: DataFrame, n_per_type: int, done: DataFrame | None = None,
                existing: DataFrame | None = None, seed: int = 42,
                key: str = "case_id", type_col: str = "type") -> DataFrame:
    """One new case per type and round until quotas or lists run out.

    A pick is an agent (round, type), and agents choose one after the other from their type's list; the
    r-th agent of a type starts at place r, as those before it take one case each. Works on the
    bounded heads of the lists (keys, no payload). Returns ``(round_robin_index, type, key)`` to join back.
    """
    heads = stored(schedule_heads(df, n_per_type, done, existing, seed, key, type_col))
    agents = heads.where(F.col("pos") <= F.col("quota")).select(F.col("pos").alias("_round"), type_col, "pos")
    picked = serial_choice(agents, heads.where("quota > 0"), ["_round", type_col], type_col, key)
    sizes = picked.groupBy("_round").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_round").rowsBetween(Window.unboundedPreceding, -1)  # a row for each round
    offsets = sizes.select("_round", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = F.row_number().over(Window.partitionBy("_round").orderBy(type_col))
    ranked = picked.withColumn("_i", inner).join(offsets, "_round")
    return ranked.select((F.col("_o") + F.col("_i") - 1).cast("bigint").alias("round_robin_index"), type_col, key)


def interleave(df: DataFrame, n_per_type: int, seed: int = 42, key: str = "case_id", type_col: str = "type") -> DataFrame:
    """Round-robin order when each case has exactly one type: rank in type, then type name."""
    w = Window.partitionBy(type_col).orderBy("_h", key)
    ranked = df.select(key, type_col).withColumn("_h", seeded_hash(seed, type_col, key)).withColumn(
        "round", F.row_number().over(w)).where(F.col("round") <= n_per_type)
    return ranked.drop("_h")


def remaining_quota(df: DataFrame, finished: DataFrame, n_per_type: int, type_col: str = "type") -> DataFrame:
    """Open quota per type after the finished cases are counted."""
    done = finished.groupBy(type_col).agg(F.count("*").alias("_done"))
    return df.select(type_col).distinct().join(done, type_col, "left").select(
        type_col, F.greatest(F.lit(0), F.lit(n_per_type) - F.coalesce("_done", F.lit(0))).alias("quota"))


def unfinished(df: DataFrame, finished: DataFrame, key: str = "case_id") -> DataFrame:
    return df.join(finished.select(key).distinct(), key, "left_anti")
