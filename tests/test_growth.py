"""Work and tasks that must not grow with a table beyond what is asked for."""

from pyspark.sql import functions as F

from changelens.functions import diffs
from changelens.operators import signals
from changelens.plans import derived as D

ODD = [
    "diff --git a/m.py b/m.py\nindex 1\n-no hunk yet\n--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-a = 1\r\n\n+++ b\n+b = 1\nplain\n-c\n-d\n+e\n",
    "--- /dev/null\n+++ b/x\n+new\n--- a/y\n+++ b/y\n-old\n+new\n@@ x\n@@ y\n-p\n--- q\n+r\n",
    "noise\n-x\n+y\n", "@@ -1 +1 @@\n-x +y\n+z", "", None,
]


def test_bodies_hold_the_runs_of_the_hunks(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, d string")
    found = signals.with_pairs(df, "d").withColumn("h", diffs.hunks("d")).select(
        "i", "pairs", diffs.line_pairs("h").alias("slow"), diffs.body_moves("bodies", "+").alias("m"),
        diffs.assignment_moves("h", "+").alias("slow_m")).orderBy("i").collect()
    assert [r["pairs"] for r in found] == [r["slow"] for r in found]
    assert [r["m"] for r in found] == [r["slow_m"] for r in found]
    assert [tuple(p) for p in found[0]["pairs"]] == [("a = 1", "b = 1"), ("c", "e")]


def test_a_task_holds_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "ROWS_A_TASK", 1000)
    spark.range(40_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    spread = D.spread(spark.read.parquet(str(tmp_path / "t")))
    most = spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 1100 and spread.count() == 40_000


def test_votes_are_exchanged_in_as_many_parts_as_the_cases_have(spark):
    cases = signals.with_pairs(spark.range(0, 50, 1, 25).select(
        F.col("id").cast("string").alias("case_id"), F.lit("@@ @\n-    x = 1\n+    self.x = 1\n-y\n+x\n").alias("commit_diff")))
    votes = signals.vote_counts(cases, renames=False)
    assert "hashpartitioning(case_id" in votes._jdf.queryExecution().toString() and ", 25)" in votes._jdf.queryExecution().toString()
    assert {(r["kind"], r["old"], r["new"], r["hits"]) for r in votes.collect()} == {("var_to_attr", "x", "self.x", 1)}
