"""Removal of repeated line runs by winnowing, in DataFrame functions.

The lines of a document that hold more than white space are hashed, twice and independently. A run is RUN neighbouring lines, or fewer
that hold LONG words; of the lines of every shortest run the one with the smallest hash is a fingerprint (the rightmost of equal ones), so
two documents that share a run share a fingerprint inside it. Fingerprints are joined by hash; one that
occurs at a single place is dropped. Around each remaining place the match is extended both ways: every run that covers it is
compared, by the 128 bits of both hashes, with the earliest place of the same run in the corpus (by document id, then by place),
and overlapping runs add up to the whole common stretch. All lines of a later run are deleted. A place is
compared with one other place, so a line that a third of all documents share makes no pairs, and the minima
are formed per task before they are exchanged.

Words are counted only in lines that can be in a run of LONG words: those that have 2 * LONG - 2 characters with their neighbours. The work
for a document is linear in its lines (but for sorting its deleted places).

Defined results: a null text stays null and has no lines; empty texts and lines of white space are kept as they are, and
runs of fewer than RUN lines and fewer than LONG words are kept; rows equal in id and text are one document and get equal results; null ids come
first; of a stretch that repeats within its document the first line stays; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.rows import let
from changelens.llm.common import key, packed, stored

RUN = 3
#: Words between white space that make a run of fewer lines.
LONG = 50
_BLANK = " \t\r\x0b\x0c"
_NO_PLACES = "CAST(array() AS array<int>)"


def holds_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(_BLANK)) != ""


def n_words(line: Column) -> Column:
    """Words of a line: one more than its single spaces, or counted by a pattern where white space is of another kind."""
    odd = line.contains("  ") | reduce(Column.__or__, [line.contains(c) for c in _BLANK[1:]]) | line.startswith(" ") | line.endswith(" ")
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(odd, F.size(F.filter(F.split(line, f"[{_BLANK}]+"), lambda w: w != ""))).otherwise(spaces + 1)


def line_table(docs: DataFrame, run: int, long: int) -> DataFrame:
    """k1, k2, h and g (two hashes of every line that holds a word), w (its words, 0 where no run of `long` words can hold it)."""
    def columns(x: Column) -> Column:
        return let(F.transform(x, lambda v: F.octet_length(v)), lambda chars: of(x, chars))

    def of(x: Column, chars: Column) -> Column:
        reach = lambda i: reduce(lambda a, k: a + F.when((i + k >= 0) & (i + k < F.size(x)), F.get(chars, i + k)).otherwise(0), [k for k in range(2 - run, run - 1) if k], F.get(chars, i))
        words = F.transform(x, lambda v, i: F.when(reach(i) >= 2 * long - run, n_words(v)).otherwise(0))
        return F.struct(F.transform(x, lambda v: F.xxhash64(v)).alias("h"), F.transform(x, lambda v: F.xxhash64(F.lit(1), v)).alias("g"), words.alias("w"))

    held = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), holds_word)
    return docs.select(*key(), let(held, columns).alias("c")).select("k1", "k2", "c.*")


def shortest_runs(w: Column, run: int, long: int) -> Column:
    """Per line the number of lines of the shortest run that begins there, null where none does."""
    def size(i: Column) -> Column:
        out = F.when(i + run <= F.size(w), run)
        words = lambda n: reduce(lambda a, k: a + F.get(w, i + k), range(1, n), F.get(w, i))
        for n in range(run - 1, 0, -1):
            out = F.when((i + n <= F.size(w)) & (words(n) >= long), n).otherwise(out)
        return out

    return F.transform(w, lambda _, i: size(i))


def winnowed(h: Column, sizes: Column) -> Column:
    """Places of the fingerprints: the rightmost minimum of each shortest run."""
    def least(n: Column, i: Column) -> Column:
        return F.when(n.isNotNull(), let(F.reverse(F.slice(h, i + 1, n)), lambda x: (i + n - F.array_position(x, F.array_min(x))).cast("int")))

    return F.array_distinct(F.filter(F.transform(sizes, least), lambda p: p.isNotNull()))


def around(seeds: Column, w: Column, run: int, long: int) -> Column:
    """All runs that cover a seed, as at * (run + 1) + size: distinct numbers are found by hash, distinct structs pair by pair."""
    def of(p: Column) -> Column:
        out = []
        for n in range(1, run + 1):
            for back in range(n):
                at = p - back
                good = (at >= 0) & (at + n <= F.size(w))
                if n < run:
                    good = good & (reduce(lambda a, k: a + F.get(w, at + k), range(1, n), F.get(w, at)) >= long)
                out.append(F.when(good, at * (run + 1) + n))
        return F.array(*out)

    return F.array_distinct(F.filter(F.flatten(F.transform(seeds, of)), lambda s: s.isNotNull()))


def repeated_stretches(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(k1, k2, starts): per document the first lines and sizes of all runs that occurred earlier."""
    lines = line_table(docs, run, long).filter((F.size("h") >= run) | (F.aggregate("w", F.lit(0), lambda a, n: a + n) >= long))
    lines = stored(lines.dropDuplicates(["k1", "k2"]).withColumn("sizes", shortest_runs(F.col("w"), run, long)), "lines")
    prints = lines.select("k1", "k2", "h", F.explode(winnowed(F.col("h"), F.col("sizes"))).alias("at"))
    prints = prints.select("k1", "k2", "at", F.element_at("h", F.col("at") + 1).alias("print"))
    often = stored(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "often")  # a table: the join can split a hot fingerprint
    seeds = prints.join(often, "print", "left_semi").groupBy("k1", "k2").agg(F.collect_list("at").alias("seeds"))
    found = lines.join(seeds, ["k1", "k2"]).select("k1", "k2", "h", "g", F.explode(around(F.col("seeds"), F.col("w"), run, long)).alias("s"))
    at, size = F.floor(F.col("s") / (run + 1)).cast("int"), F.col("s") % (run + 1)
    part = lambda c: F.xxhash64(size, F.slice(c, at + 1, size))
    found = stored(found.select("k1", "k2", at.alias("at"), size.alias("size"), part("h").alias("s1"), part("g").alias("s2")), "stretches")
    place = F.struct("k1", "k2", "at")
    first = stored(found.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    later = found.join(first, ["s1", "s2"]).filter(place > F.col("first"))
    return later.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "size")).alias("starts"))


def without_repeats(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """The documents with all their columns (in `row`), n_lines, removed (places of deleted lines among all lines, from 0) and clean_text."""
    k1, k2 = key()
    rows = packed(docs, k1=k1, k2=k2).join(repeated_stretches(docs, run, long), ["k1", "k2"], "left").withColumn("text", F.col("row.text"))

    def cut(lines: Column) -> Column:
        held = F.filter(F.transform(lines, lambda x, i: F.when(holds_word(x), i)), lambda i: i.isNotNull())
        runs = F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
        gone = F.sort_array(F.array_distinct(runs))
        removed = let(held, lambda at: F.transform(gone, lambda g: F.get(at, g)))
        def rest(places: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
            return F.struct(places.alias("removed"), F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("clean_text"))

        return let(removed, rest)

    whole = F.struct(F.expr(_NO_PLACES).alias("removed"), F.col("text").alias("clean_text"))
    rows = rows.withColumn("cut", F.when(F.col("starts").isNull(), whole).otherwise(let(F.split("text", "\n"), cut)))
    n_lines = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return rows.select("row", F.coalesce(n_lines, F.lit(0)).alias("n_lines"), "cut.removed", "cut.clean_text")
