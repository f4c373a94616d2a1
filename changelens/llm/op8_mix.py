"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Each source's documents, in the order of a seeded digest, are cut into blocks of `block_chars` characters.
A source's weight w is its part of all target weights, a whole number of 2**31 parts. Block j is released at slot
floor(j / w) and due by slot ceil((j + 1) / w), both exact; earliest deadline first (ties: the source first in order) gives every
block a slot inside that window, so after any number of slots a source is less than one block away from its target share.

The schedule is a fold over the blocks, in one row that holds a number per source: it goes from block to block and passes over
slots for which none is released, so a source that has run out leaves its slots empty and the others keep their
proportions. To bound that row, a corpus is cut into at most about SLOTS blocks: `block_chars` is BLOCK_CHARS, or more where
SLOTS blocks of that size would not hold the corpus. Any number of sources is served; a step costs the sources that are not done.

No source is numbered in one task: a document's place comes from the sums of (source, digest prefix) cells in two levels, and
the prefix is as long as cells of about CELL_ROWS rows need. Every document is placed exactly once.

Defined results: null is a source of its own; null and empty texts take no room but have a block; rows equal
in id and text are interchangeable; sources without a target, or with none above zero, come after all others (slot null); empty tables give no
rows; extra columns pass through `in_mix_order`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.rows import let
from changelens.llm.common import key, packed, stored

PARTS = 1 << 31
BLOCK_CHARS = 65_536
#: Blocks of a schedule, about; a larger corpus has larger blocks.
SLOTS = 32_768
CELL_ROWS = 1024
SEED = 17


def source_key(source: Column | str = "source") -> Column:
    source = F.col(source) if isinstance(source, str) else source
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The stored rows to be placed: doc_id, k1, k2, src, digest, n (characters)."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return stored(docs.select("doc_id", *key(), source_key().alias("src"), digest.alias("digest"), F.length(text).cast("long").alias("n")), "sized")


def root_targets(rows: DataFrame) -> DataFrame:
    """(src, weight): the square root of each source's characters, which lifts small sources."""
    return rows.groupBy("src").agg(F.sqrt(F.sum("n").cast("double")).alias("weight"))


def shares(targets: DataFrame) -> DataFrame:
    """(src, w): whole parts of the weights above zero, about PARTS in all, at least one each."""
    given = targets.filter("weight > 0")
    total = given.agg(F.sum("weight").alias("total"))
    return given.withColumn("total", total.scalar()).select("src", F.greatest(F.round(F.col("weight") / F.col("total") * PARTS).cast("long"), F.lit(1)).alias("w"))


def block_size(rows: DataFrame) -> int:
    """BLOCK_CHARS, or as many more characters as SLOTS blocks need to hold all."""
    return max(BLOCK_CHARS, -(-(rows.agg(F.sum("n")).first()[0] or 0) // SLOTS))


def schedule(parts: DataFrame) -> DataFrame:
    """(src, block, release, deadline, slot) of blocks 0..n-1 of every source; `parts` has src, w, n.

    The state is the list of open sources with their next block's release and deadline.
    """
    one = parts.agg(F.sort_array(F.collect_list(F.struct("src", "w", "n"))).alias("s"), F.sum("w").alias("total"), F.sum("n").alias("n_blocks")).filter("n_blocks > 0")
    total = F.col("total")

    def times(block: Column, w: Column) -> tuple[Column, Column]:
        whole = lambda x: F.call_function("div", x, w)
        return whole(block * total), whole((block + 1) * total + w - 1)

    def source(i: Column, block: Column, w: Column, n: Column) -> Column:
        release, due = times(block, w)
        return F.struct(due.alias("due"), i.alias("i"), release.alias("release"), block.alias("block"), w.alias("w"), n.alias("n"))

    def step(state: Column, _: Column) -> Column:
        t = F.greatest(state["t"], F.array_min(F.transform(state["open"], lambda x: x["release"])))

        def picked(now: Column) -> Column:
            best = F.array_min(F.filter(state["open"], lambda x: x["release"] <= now))
            return let(best, lambda p: F.struct(
                (now + 1).alias("t"),
                F.filter(F.transform(state["open"], lambda x: F.when(x["i"] == p["i"], source(x["i"], x["block"] + 1, x["w"], x["n"])).otherwise(x)), lambda x: x["block"] < x["n"]).alias("open"),
                F.array_append(state["picks"], F.struct(p["i"].alias("i"), p["block"].alias("block"), p["release"].alias("release"), p["due"].alias("due"), now.alias("slot"))).alias("picks")))

        return let(t, picked)

    begin = F.transform("s", lambda x, i: source(i.cast("long"), F.lit(0).cast("long"), x["w"], x["n"]))
    none = F.expr("CAST(array() AS array<struct<i: bigint, block: bigint, release: bigint, due: bigint, slot: bigint>>)")
    start = F.struct(F.lit(0).cast("long").alias("t"), F.filter(begin, lambda x: x["block"] < x["n"]).alias("open"), none.alias("picks"))
    picks = one.select("s", F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n_blocks")), start, step, lambda x: x["picks"]).alias("picks"))
    return picks.select("s", F.explode("picks").alias("p")).select(F.get("s", F.col("p.i").cast("int"))["src"].alias("src"), "p.block", "p.release", F.col("p.due").alias("deadline"), "p.slot")


def place(rows: DataFrame, targets: DataFrame, block_chars: int) -> DataFrame:
    """The stored rows with offset (characters of the source before), block, release, deadline and slot."""
    digits = max(0, math.ceil(math.log(max(1, rows.count() / CELL_ROWS), 16)))
    rows = rows.withColumn("cell", F.substring("digest", 1, digits))
    cells = rows.groupBy("src", "cell").agg(F.sum("n").alias("chars")).withColumn("outer", F.substring("cell", 1, digits // 2))
    outer = cells.groupBy("src", "outer").agg(F.sum("chars").alias("outer_chars"))
    outer = outer.withColumn("outer_before", F.sum("outer_chars").over(Window.partitionBy("src").orderBy("outer")) - F.col("outer_chars")).drop("outer_chars")
    before = F.sum("chars").over(Window.partitionBy("src", "outer").orderBy("cell")) - F.col("chars")
    cells = cells.withColumn("inner_before", before).join(outer, ["src", "outer"]).select("src", "cell", (F.col("inner_before") + F.col("outer_before")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("src", "cell").orderBy("digest", "k2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    found = rows.withColumn("inside", inside).join(cells, ["src", "cell"]).withColumn("offset", F.col("before") + F.col("inside"))
    found = found.withColumn("block", F.floor(F.col("offset") / block_chars))
    sizes = rows.groupBy("src").agg((F.floor(F.sum("n") / block_chars) + 1).alias("n"))
    plan = stored(schedule(shares(targets).join(sizes, "src")), "schedule")  # a row for each block
    return found.join(plan, ["src", "block"], "left").drop("inside", "before", "cell")


def mixed(docs: DataFrame, targets: DataFrame | None = None, block_chars: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, offset, block, release, deadline, slot of every document. `targets` (source, weight), or root_targets."""
    rows = sized(docs, seed)
    given = root_targets(rows) if targets is None else targets.select(source_key().alias("src"), F.col("weight").cast("double").alias("weight"))
    found = place(rows, given, block_chars or block_size(rows))
    return found.select("doc_id", "k1", "k2", F.when(F.col("src") != "null", F.substring("src", 2, 1 << 30)).alias("source"), "offset", "block", "release", "deadline", "slot")


def in_mix_order(docs: DataFrame, targets: DataFrame | None = None, block_chars: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents with all their columns, range-partitioned and sorted by slot: written files hold them in the mix's order."""
    slots = mixed(docs, targets, block_chars, seed).groupBy("k1", "k2").agg(F.min(F.struct(F.col("slot").isNull().alias("late"), "slot", "source", "offset")).alias("at"))
    k1, k2 = key()
    rows = packed(docs, k1=k1, k2=k2).join(slots, ["k1", "k2"])
    order = ["at", "k1", "k2"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
