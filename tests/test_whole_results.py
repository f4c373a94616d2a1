"""Nothing is cut, and rows that share a key or hold nulls keep an answer of their own."""

from pyspark.sql import functions as F

from changelens.functions import diffs, text
from changelens.operators import filters, rules, sampling

CASES = "case_id string, commit_diff string, refactoring_types array<string>"


def test_type_size_decides_per_row(spark):
    rows = [("a", "x" * 10, ["T"]), ("a", "x" * 100, ["T"]), ("b", "x" * 10, ["T"]), ("c", "x" * 10, [None]), ("d", "x" * 90, [None]),
            ("e", "x" * 10, [None, "T"]), ("f", "x" * 999, None), ("g", "x" * 999, []), (None, "x" * 10, ["T"]), (None, "x" * 200, ["T"]), ("h", None, ["T"]), ("a", "x" * 10, ["T"])]
    df = spark.createDataFrame(rows, CASES)
    sizes: dict = {}
    for _, d, ts in rows:
        for t in ts or []:
            sizes.setdefault(t, []).append(len(d or ""))
    want = [r for r in rows if all(len(r[1] or "") <= 2 * sum(sizes[t]) / len(sizes[t]) for t in r[2] or [])]
    assert sorted(map(tuple, filters.within_type_size(df).collect()), key=repr) == sorted(want, key=repr)
    few = filters.within_type_size(df, absolute_max=50).collect()
    assert sorted(map(tuple, few), key=repr) == sorted((r for r in want if len(r[1] or "") <= 50), key=repr)


def test_more_than_twenty_of_each(spark):
    long = "y" * 200
    body = "".join(f"@@ -{i},1 +{i},1 @@\n-    if a{i} == {long}{i}:\n+    if a{i} != {long}{i}:\n" for i in range(1, 41))
    types = "".join(f"@@ -{i},1 +{i},1 @@\n-    v{i}: {long}\n+    v{i}: {long}2\n" for i in range(1, 41))
    df = spark.createDataFrame([("--- a/m.py\n+++ b/m.py\n" + body, "--- a/m.py\n+++ b/m.py\n" + types)], "d string, t string")
    r = df.select(diffs.inversions(diffs.line_pairs(diffs.hunks("d"))).alias("i"), diffs.type_changes(diffs.line_pairs(diffs.hunks("t"))).alias("t")).first()
    assert len(r["i"]) == 40 and all(long in x["before"] for x in r["i"])
    assert len(r["t"]) == 40 and all(x["after"] == long + "2" for x in r["t"])


def test_long_keys_stay_apart(spark):
    same = "x" * 400
    df = spark.createDataFrame([("https://a/" + same,), ("https://b/" + same,), ("u" * 180,)], "url string")
    none = F.lit(None).cast("string")
    got = [r[0] for r in df.select(text.case_key(none, "url", none)).collect()]
    assert len(set(got)) == 3 and all(len(k) <= 180 for k in got) and got[2] == "u" * 180


def test_rank_over_many_buckets(spark):
    n = 3 * sampling.BUCKET_ROWS
    df = spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    got = sampling.global_rank(df, "h").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, n + 1)) and [r["h"] for r in got] == sorted(r["h"] for r in got)


def test_votes_by_edges_match_votes_in_the_row(spark):
    hints = {"A": ["B", "C"], "D": ["C", "A"], "E": []}
    edges = spark.createDataFrame([(s, i, d) for s, ds in hints.items() for i, d in enumerate(ds)], "src string, ord int, dst string")
    df = spark.createDataFrame([("1", ["A", "D"]), ("2", ["E"]), ("3", []), ("4", ["A"])], "case_id string, labels array<string>")
    for cap in (None, 2):
        want = {r[0]: r[1] for r in df.select("case_id", rules.vote_candidates("labels", hints, cap, always=["Z", "A"])).collect()}
        assert {r[0]: r[1] for r in rules.voted_by_edges(df, edges, cap, always=["Z", "A"]).collect()} == want


def test_pruned_rules_are_the_frequent_ones(spark):
    import random

    r = random.Random(1)
    cases = [(i, sorted(r.sample("ABCDEFGH", r.randint(1, 5)))) for i in range(60)] + [(99, ["A", "rare"])]
    sets = rules.label_sets(spark.createDataFrame([(i, x) for i, xs in cases for x in xs], "case_id int, label string"))
    every = {tuple(x) for x in rules.association_rules(sets).where("n_xc >= 9").collect()}
    assert every and {tuple(x) for x in rules.association_rules(sets, 9).collect()} == every


def test_names_inside_stray_marks(spark):
    from changelens.functions import replies

    given = ["Move Class", " <type>Move Class</type", "<x>'Move Class'", '""Move Class""', "<open Move Class", "a < b < c", " ' Move Class ' ", "", "\n<type evidence=\"e\">Move\nClass </type>x"]
    df = spark.createDataFrame([(g,) for g in given], "t string")
    assert [r[0] for r in df.select(replies.clean_name("t")).collect()] == ["Move Class", "Move Class", "Move Class", "Move Class", "", "a", "Move Class", "", "Move\nClass </type>x"]
