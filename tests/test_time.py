"""Joins over time, event-time windows and sketches against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from changelens.operators import rollups, temporal
from changelens.streaming import windows

DAY = datetime(2024, 1, 1)


def test_as_of_carries_over_empty_buckets_and_hot_keys(spark):
    r = random.Random(3)
    when = lambda: DAY + timedelta(minutes=r.randrange(60 * 24 * 20))
    left = [(i, r.choice(["hot", "hot", "a", "b", None]), when()) for i in range(150)] + [(900, "hot", None)]
    right = sorted({(r.choice(["hot", "a", None]), when()) for _ in range(25)}, key=repr)
    got = temporal.as_of(spark.createDataFrame(left, "id long, k string, t timestamp"), spark.createDataFrame([(*x, i) for i, x in enumerate(right)], "k string, t timestamp, no long"), ["k"], "t", 6 * 3600)
    want = {}
    for i, k, t in left:
        seen = [(rt, no) for no, (rk, rt) in enumerate(right) if t and k and rk == k and rt <= t]
        want[i] = max(seen)[1] if seen else None
    assert {x.id: x.match and x.match.no for x in got.collect()} == want
    assert any(v is not None for v in want.values())


def test_intervals_of_all_lengths(spark):
    r = random.Random(4)
    spans = [(i, r.choice("ab"), s, s + r.choice([0, 1, 7, 300, 40_000, 10**8, 10**13])) for i, s in ((i, r.randrange(-1000, 1000)) for i in range(60))] + [(99, "a", None, 5)]
    points = [(i, r.choice("ab"), r.choice([r.randrange(-2000, 2000), r.randrange(10**8)])) for i in range(80)] + [(500, None, 3), (501, "a", None)]
    got = temporal.in_intervals(spark.createDataFrame(points, "p long, k string, t long"), spark.createDataFrame(spans, "s long, k string, lo long, hi long"), ["k"], "t", "lo", "hi", 10)
    want = sorted((p, s) for p, k, t in points for s, sk, lo, hi in spans if k == sk and None not in (t, lo) and lo <= t < hi)
    assert sorted((x.p, x.s) for x in got.select("p", "s").collect()) == want


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    schema = "ts timestamp, k string"
    at = lambda h: DAY + timedelta(hours=h)
    for i, hours in enumerate(([0, 0.5, 10], [0.2, 9.5], [30])):  # 0.2 is behind 10 - 2 hours, 9.5 is not
        rows = spark.createDataFrame([(at(h), "x") for h in hours], schema).coalesce(1)
        rows.write.parquet(f"{tmp_path}/in{i}")
    for i in range(3):  # one batch each, in this order
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = windows.windowed(windows.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in0").schema), "ts", "k", windows.tumbling("ts", "1 hour"), "2 hours", F.count("*").alias("n"))
        windows.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((x.start, x.n) for x in spark.read.parquet(f"{tmp_path}/out").select("start", "n").collect())
    assert got == [(at(0), 2), (at(9), 1), (at(10), 1)]  # the window of hour 30 is still open


def test_sketches_of_parts_merge(spark):
    df = spark.range(20_000).selectExpr("id % 7 AS part", "id % 3 AS g", "id % 5000 AS who", "CAST(id AS DOUBLE) AS v")
    parts = rollups.sketches(df, ["part", "g"], "who", "v")
    got = {r.g: r for r in rollups.estimates(rollups.merged(parts, "g"), 0.5, 0.9).collect()}
    for g in range(3):
        assert got[g].n in (6666, 6667)
        assert abs(got[g].n_distinct - 5000) <= rollups.COUNT_ERROR * 5000
        assert abs(got[g].q50 / 20_000 - 0.5) <= rollups.RANK_ERROR and abs(got[g].q90 / 20_000 - 0.9) <= rollups.RANK_ERROR
