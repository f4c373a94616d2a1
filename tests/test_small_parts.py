import json

from pyspark.sql import functions as F

from changelens import schemas
from changelens.functions import text
from changelens.operators import context, retrieval, rules, scoring
from changelens.sources import dimensions, external, logs


def test_label_texts(spark):
    df = spark.createDataFrame([("Method Level, x,class_level", ["Move Class"])], "lv string, t array<string>")
    row = df.select(text.parse_level_list("lv").alias("lv"), text.has_level("t", "class_level").alias("c"), text.has_level("t", "method_level").alias("m"),
                    rules.combined_hints(F.lit("Split Conditional"), {"Split Conditional": ["Add Parameter", "Rename Variable"]}).alias("h")).first()
    assert (row["lv"], row["c"], row["m"]) == (["method_level", "class_level"], True, False)
    assert row["h"] == ["Extract Method", "Add Parameter", "Rename Variable"]


def test_exemplar_summary_and_anchors(spark):
    ex = ("a", "T", 0.5, None, "d", "c" * 1501, None, None, None, None, None, "u", None)
    df = spark.createDataFrame([([ex] * 21 + [(None,) * 13],)], f"e array<{schemas.EXEMPLAR}>")
    row = df.select(context.summarize_exemplars("e").alias("s"), retrieval.anchor_ids(F.col("e")).alias("a")).first()
    assert len(row["s"]) == 20 and row["s"][0]["code_text_truncated"].endswith("c...[truncated]") and row["a"] == ["a"] * 21


def test_mean_pool(spark):
    ix = spark.createDataFrame([(0, "a", "L", [3.0, 0.0]), (1, "b", "L", [0.0, 2.0]), (2, "c", "L", [0.0, -5.0])], "row_id long, id string, label string, embedding array<float>")
    anchors = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "zz"), ("none", "zz"), ("flat", "b"), ("flat", "c")], "query_id string, id string")
    got = {r["query_id"]: [round(x, 6) for x in r["vec"]] for r in retrieval.mean_pool_queries(ix, anchors, 2).collect()}
    assert got == {"q": [0.707107, 0.707107]}


def test_error_rows_count_as_misses(spark):
    df = spark.createDataFrame([("c", ["Move Class", "odd"])], "case_id string, truth array<string>")
    bad = scoring.error_rows(df, "truth").withColumn("status", F.lit("ERROR"))
    skipped = bad.withColumn("status", F.lit("SKIPPED"))
    ok = bad.withColumn("status", F.lit("OK")).withColumn("tp", F.lit(1)).withColumn("fn", F.lit(0))
    row = scoring.micro(bad.unionByName(skipped).unionByName(ok)).first()
    assert (row["n"], row["skipped"], row["tp"], row["fp"], row["fn"], row["r"]) == (3, 1, 1, 0, 1, 0.5)


def test_more_tables(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    assert [r[0] for r in dimensions.read_label_list(spark, put("l.json", ["A", "B"])).collect()] == ["A", "B"]
    assert [tuple(r) for r in dimensions.read_text_book(spark, put("t.json", {"A": "x"})).collect()] == [("A", "x")]
    w = dimensions.read_weights(spark, put("w.json", {"alpha": 1.0, "beta": 2.0, "gamma": 3.0, "cap_per_level": {"class_level": 5},
                                                      "type_priors_per_level": {"class_level": {"A": 0.1}}, "type_priors_global": {"A": 0.2}})).first()
    assert (w["beta"], w["cap_per_level"], w["type_priors_per_level"]["class_level"]["A"]) == (2.0, {"class_level": 5}, 0.1)


def test_commit_text_and_parser(spark):
    df = spark.createDataFrame([("u", "b.py", "after", "x" * 6000, None), ("u", "a.py", "after", None, "HTTP 404"), ("u", "c.txt", "after", "t", None)],
                               "url string, file_path string, version string, code string, error string")
    full = external.commit_text(df).first()["full_commit"]
    assert full == "# a.py\nError: HTTP 404\n\n# b.py\n" + "x" * 5000

    def parser(code):
        if not code:
            raise RuntimeError("rc=1")
        return f"module [0,{len(code)}]"

    files = spark.createDataFrame([("c", "before", "a.py", "abc"), ("c", "after", "a.py", "")], "case_id string, side string, file string, code string")
    got = {r["side"]: (r["dump"], r["error"]) for r in external.parse_with(files, parser).collect()}
    assert got == {"before": ("module [0,3]", None), "after": (None, "RuntimeError: rc=1")}


def test_evaluation_and_failure_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    logs.write_evaluation(df, df, str(tmp_path), "s1")
    logs.write_failures(df, str(tmp_path / "fail"))
    logs.write_failures(df, str(tmp_path / "fail"))
    assert spark.read.json(str(tmp_path / "evaluation_s1")).count() == 1
    assert spark.read.json(str(tmp_path / "fail")).count() == 2


def test_evaluation_text(spark):
    from changelens.operators import scoring
    from changelens.sources import logs

    rows = [(["Move Class", "odd"], ["Move Class"], "OK"), (["Add Parameter", "odd", "rare"], ["Move Class"], "OK"), ([], ["Move Class"], "ERROR"), ([], ["Add Parameter"], "SKIPPED")]
    df = spark.createDataFrame(rows, "p array<string>, t array<string>, status string")
    text = logs.evaluation_text(scoring.micro(scoring.case_metrics(df, "p", "t")), scoring.per_type(df, "p", "t"), scoring.undefined_counts(df, "p"), top=1)
    assert "| 4 | 1 | 1 | 1 | 2 | 0.500 | 0.333 | 0.400 |" in text
    assert "| 1 | 0 | 1 | 1.000 | 0.500 |" in text and "rename" not in text
    assert "| 3 | 2 |" in text and "| odd | 2 |" in text and "rare" not in text


def test_shared_folder_without_the_setting():
    from types import SimpleNamespace

    import pytest

    from changelens.plans.session import checkpoint_dir

    def session(master, named=None):
        made = []
        context = SimpleNamespace(master=master, setCheckpointDir=made.append)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context), made

    local, made = session("local[2]")
    first = checkpoint_dir(local)
    assert first.startswith("file:///") and checkpoint_dir(local) == first and made == [first, first]
    assert checkpoint_dir(session("spark://host:7077", "hdfs://shared/x")[0]) == "hdfs://shared/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("spark://host:7077")[0])
