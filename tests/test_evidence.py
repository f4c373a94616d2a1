"""Evidence of a case, worked out in its row, against the grouped and joined form."""

import random

from pyspark.sql import functions as F
from test_structure import odd_case

from changelens.operators import filters, signals, structure
from changelens.plans import registry

CASE = "case_id string, commit_diff string, code_before array<struct<file:string,code:string>>, code_after array<struct<file:string,code:string>>"


def odd_diff(r):
    if r.random() < 0.1:
        return r.choice([None, "", "noise", "@@ x\n-a\n"])
    name = lambda: r.choice(["a", "b", "c", "self.a", "self.b", "cfg.get(a.b)", "d: int"])
    line = lambda: r.choice([f"{name()} = {name()}", f"if {name()} and {name()}:", f"    if {name()} != {name()}:", f"use({name()}, {name()}, {name()})"])

    def run():
        if r.random() < 0.5:
            return "".join(f"{s}{line()}\n" for s in "-+" for _ in range(r.randint(0, 3)))
        names = [(r.choice("abc"), r.choice("xyz")) for _ in range(r.randint(1, 4))]  # renames, at times to two names
        return "".join(f"{s}call({', '.join(p[i] for p in names)})\n" for i, s in enumerate("-+"))

    return "--- a/m\n+++ b/m\n" + "".join(f"@@ {i}\n same\n" + "".join(run() + " same\n" for _ in range(r.randint(1, 3))) for i in range(r.randint(1, 4)))


def odd_cases(spark, shared):
    r = random.Random(11)
    rows = [(i, odd_diff(r), *odd_case(r, "")[1:]) for i in map(str, range(200))]
    rows += [(r.choice(["3", "4", None, "x"]), odd_diff(r), *odd_case(r, "")[1:]) for _ in range(9 if shared else 0)]
    return spark.createDataFrame(rows, CASE)


def named(row):
    """A struct with its lists in order; names that are sets have none."""
    return None if row is None else {k: sorted(map(repr, v)) for k, v in row.asDict().items()}


def test_signals_of_a_row_equal_the_grouped_ones(spark):
    df = odd_cases(spark, False)
    key = lambda d: sorted(map(repr, d.select("case_id", "signals").collect()))
    rows = signals.with_row_signals(df)
    assert key(rows) == key(signals._grouped_signals(signals.with_pairs(df)))
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    counts = rows.select(F.size("signals.renames").alias("n"), F.size("signals.self_swaps").alias("m")).agg(F.sum("n"), F.sum("m")).first()
    assert counts[0] > 10 and counts[1] > 10


def test_evidence_of_a_row_equals_the_joined_one(spark):
    for shared in (False, True):
        df = odd_cases(spark, shared)
        facts = structure.facts_summary(structure.compute_facts(df))
        packed = facts.select("case_id", F.struct(*[c for c in facts.columns if c != "case_id"]).alias("facts"))
        tags = signals._grouped_signals(signals.with_pairs(df)).select("case_id", signals.signal_tags("signals").alias("tags"))
        want = df.select("case_id", "commit_diff").join(packed, "case_id", "left").join(tags, "case_id", "left")
        got = filters.with_evidence(df)
        assert got.columns == want.columns
        plain = lambda d: sorted(repr((x.case_id, x.commit_diff, named(x.facts), x.tags)) for x in d.collect())  # noqa: E731, B023
        assert plain(got) == plain(want)
        assert any(x.facts and x.facts.before_params for x in got.collect())
    assert got.where("case_id IS NULL").count() == got.where("case_id IS NULL AND facts IS NULL AND tags IS NULL").count() > 0


def test_cases_with_ids_of_their_own_meet_no_join(spark):
    plan = registry.QUERIES["evidence_gates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan
