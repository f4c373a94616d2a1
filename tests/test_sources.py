import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens import schemas
from changelens.operators import retrieval
from changelens.sources import cases, dimensions, exemplars, external, logs
from changelens.streaming import runner


def test_four_layouts_in_one_file(spark, tmp_path):
    ex = {"id": "a", "refactoring_type": "T", "similarity": 0.5, "description": "d"}
    items = [
        {"refactorings": [{"type": "X", "matched_java_examples": [ex, {**ex, "id": "b", "similarity": 0.1}]},
                          {"type": "X", "matched_java_examples": [{**ex, "similarity": 0.7, "description": "e"}]}, {"type": ""}],
         "code_before": [{"file": "m.py", "code": "a"}], "code_after": [{"file": "m.py", "code": "b"}, {"file": "n.py", "code": "c"}], "url": "u:1"},
        {"python_refactoring": {"refactoring_type": ["P", "Q"], "code_before": [], "code_after": [], "commit_diff": "dd", "url": "u2"}, "java_examples": [ex]},
        {"refactoring_type": "F", "matched_java_examples": [], "code_before": "old", "code_after": "new"},
        {"refactoring_types": ["G"], "commit_diff": "-x", "url": "u4"},
        {"url": "ignored"},
    ]
    path = tmp_path / "c.json"
    path.write_text(json.dumps(items))
    got = {r["fmt"] + (r["url"] or r["commit_diff"]): r for r in cases.read_cases(spark, str(path)).collect()}
    new, old, flat, commit = got["newu:1"], got["oldu2"], got["flatBEFORE:\nold\n---\nAFTER:\nnew"], got["commitu4"]
    assert new["refactoring_types"] == ["X", "X"] and new["case_id"] == "u_1"
    assert new["commit_diff"] == "=== m.py ===\nBEFORE:\na\nAFTER:\nb\n---"
    assert [(e["id"], e["similarity"], e["description"]) for e in new["java_examples"]] == [("a", 0.7, "e"), ("b", 0.1, "d")]
    assert (old["refactoring_types"], old["commit_diff"], len(old["java_examples"])) == (["P", "Q"], "dd", 1)
    assert flat["refactoring_types"] == ["F"] and flat["code_before"][0]["file"] == "unknown.py"
    assert commit["refactoring_types"] == ["G"] and len(got) == 5


def test_matrix_pool_and_trophies(spark, tmp_path):
    mat = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", mat)
    (tmp_path / "meta.json").write_text(json.dumps({"ids": list("abcd"), "labels": list("xxyy")}))
    ix = retrieval.checked_index(exemplars.read_npy(spark, str(tmp_path / "m.npy"), 3), exemplars.read_meta(spark, str(tmp_path / "meta.json")))
    assert [(r["id"], r["label"], r["embedding"]) for r in ix.orderBy("row_id").collect()] == [
        (i, lb, row.tolist()) for i, lb, row in zip("abcd", "xxyy", mat)]
    for name, recs in (("java_records_1.json", [{"id": "a", "description": "1"}, {"description": "no id"}]),
                       ("java_records_2.json", [{"id": "a", "description": "2"}]), ("java_records_3.json.no_prefix_backup", [{"id": "z"}])):
        (tmp_path / name).write_text(json.dumps({"records": recs}))
    assert [(r["id"], r["description"]) for r in exemplars.read_pool_json(spark, str(tmp_path)).collect()] == [("a", "2")]
    (tmp_path / "p.pkl").write_bytes(pickle.dumps([{"id": "q", "description": "1"}, {"id": "q", "description": "2"}, {"x": 1}]))
    assert [(r["id"], r["description"]) for r in exemplars.read_pool_pickle(spark, str(tmp_path / "p.pkl")).collect()] == [("q", "2")]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"url": u, "ground_truth": ["T"], "diff_snippet": "d"}) for u in "abcd"))
    tr = exemplars.read_trophies(spark, str(tmp_path / "t.jsonl"), str(tmp_path / "m.npy")).orderBy("row_id").collect()
    assert [(r["url"], r["embedding"][0]) for r in tr] == [("a", 0.0), ("b", 3.0), ("c", 6.0), ("d", 9.0)]
    assert exemplars.read_trophies(spark, str(tmp_path / "none"), str(tmp_path / "m.npy")).count() == 0
    (tmp_path / "urls.json").write_text(json.dumps(["u1", "u2", "u1", "u3"]))
    q = exemplars.query_channels(exemplars.read_urls(spark, str(tmp_path / "urls.json")), exemplars.read_npy(spark, str(tmp_path / "m.npy")))
    assert {r["url"]: r["channel_0"][0] for r in q.collect()} == {"u1": 6.0, "u2": 3.0, "u3": 9.0}


def test_dimensions(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    defs = dimensions.read_definitions(spark, put("d.json", [{"refactoring_type": "A", "definition": "1"}, {"refactoring_type": "A", "definition": "2"}]))
    assert [tuple(r) for r in defs.collect()] == [("A", "2")]
    edges = dimensions.read_hint_edges(spark, put("h.json", {"A": ["B", "C"]}))
    assert [tuple(r) for r in edges.orderBy("ord").collect()] == [("A", 1, "B"), ("A", 2, "C")]
    rules = dimensions.read_rules(spark, put("r.json", {"A|B": [{"consequent": "X", "score": 0.4}]}))
    assert [tuple(r) for r in rules.collect()] == [("A|B", "X", 0.4)] and dimensions.read_rules(spark, "/none").count() == 0
    hist = dimensions.read_history(spark, put("p.json", {"per_type": {"T": {"support": 3, "precision": 0.5}}}))
    assert [tuple(r) for r in hist.collect()] == [("T", 3, 0.5)]


def test_log_survives_broken_lines(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "part.json").write_text('{"case_id":"a","scheduled_for_type":"T"}\n\n{broken\n{"case_id":"b","scheduled_for_type":"T"}\n')
    df = logs.read_log(spark, str(log))
    assert sorted(r[0] for r in logs.finished_cases(df).collect()) == ["a", "b"]
    assert [tuple(r) for r in logs.finished_per_type(df).collect()] == [("T", 2)]
    assert logs.read_log(spark, str(tmp_path / "none")).count() == 0


def test_external_steps(spark):
    def fetch(owner, repo, ref, path):
        if path == "b.py":
            raise OSError("HTTP 404")
        return f"x = 1  # {owner}/{repo}@{ref}"

    url = "https://github.com/o/r/commit/abc123"
    req = spark.createDataFrame([(url, "a.py", "before"), (url, "b.py", "after"), ("bad", "a.py", "after")], "url string, file_path string, version string")
    got = {(r["url"], r["file_path"]): r for r in external.fetch_files(req, fetch).collect()}
    assert got[(url, "a.py")]["code"] == "x = 1" and got[(url, "b.py")]["error"] == "HTTP 404" and "parse" in got[("bad", "a.py")]["error"]
    dump = ("module [0,90]\n    class_definition [0,59]\n        identifier: A [6,7]\n        block [9,59]\n            function_definition [9,59]\n"
            "                identifier: m [13,14]\n    function_definition [60,90]\n        identifier: f [64,65]\nnoise")
    row = spark.createDataFrame([(dump,)], "d string").select(
        external.dump_rows("d").alias("rows"), external.subtrees("d", "class_definition").alias("cls"),
        external.subtrees("d", "function_definition").alias("fn")).first()
    assert len(row["rows"]) == 8 and tuple(row["rows"][2]) == (2, 2, "identifier", "A", 6, 7)
    assert len(row["cls"]) == 1 and row["cls"][0].count("\n") == 4
    assert [x.split("identifier: ")[1][0] for x in row["fn"]] == ["m", "f"]
    kids = spark.createDataFrame([(row["cls"][0],)], "d string").select(external.children("d").alias("k"), external.children("d", "block").alias("b")).first()
    assert [k["type"] for k in kids["k"]] == ["identifier", "block"] and len(kids["b"]) == 1


def predict(case, examples):
    if "boom" in case["commit_diff"]:
        raise ValueError("boom")
    return {"final_types": ["Move Class", "UnknownType: z"]}


def test_restart_runs_each_case_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, *urls, diff="-x"):
        (src / name).write_text("\n".join(json.dumps({"refactoring_types": ["Move Class"], "commit_diff": diff, "url": u}) for u in urls))

    def go():
        return runner.run_incremental(spark, str(src), str(tmp_path / "log"), str(tmp_path / "cp"), lambda c: runner.evaluate(c, predict))

    put("1.json", "u1", "u2", "u1")
    put("2.json", "u3", diff="boom")
    go()
    put("3.json", "u3", "u4")
    go()
    assert go() == 0
    rows = sorted((r["case_id"], r["tp"], r["fp"], r["fn"], tuple(r["final_undefined"])) for r in logs.read_log(spark, str(tmp_path / "log")).collect())
    assert rows == [("u1", 1, 0, 0, ("UnknownType: z",)), ("u2", 1, 0, 0, ("UnknownType: z",)), ("u3", 0, 0, 1, ()), ("u4", 1, 0, 0, ("UnknownType: z",))]


def test_a_batch_that_fails_after_writing_is_replayed_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    put = lambda name, *urls: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"refactoring_types": ["Move Class"], "commit_diff": "-x", "url": u}) for u in urls))
    log = str(tmp_path / "log")
    logs.append_log(logs.case_record(runner.evaluate(cases.normalize(spark.read.schema(schemas.RAW_CASE).json(spark.sparkContext.parallelize(['{"url": "old", "commit_diff": "-x", "refactoring_types": ["Move Class"]}']))), predict)), log)
    asked = []

    def go():
        return runner.run_incremental(spark, str(tmp_path / "in"), log, str(tmp_path / "cp"), lambda c: (asked.append(1), runner.evaluate(c, predict))[1])

    put("1.json", "u1", "old")
    assert go() == 1
    put("2.json", "u1", "u2")
    real = logs.write_batch

    def broken(rows, path):
        real(rows, path)
        raise OSError("lost after writing")

    monkeypatch.setattr(logs, "write_batch", broken)
    with pytest.raises(Exception, match="lost after writing"):
        go()
    monkeypatch.setattr(logs, "write_batch", real)
    put("3.json", "u2", "u3")
    assert go() == 2
    assert len(asked) == 3  # the batch that was written whole is not processed again
    assert sorted(r["case_id"] for r in logs.read_log(spark, log).collect()) == ["old", "u1", "u2", "u3"]


def test_report_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("T1", 2, 1, 1, 0, 0.5, 1.0, 0.667)], "track string, n int, tp int, fp int, fn int, p double, r double, f1 double")
    changes = scores.select("track", *[F.lit(0.0).alias(c) for c in ("d_p", "d_r", "d_f1")])
    text = logs.headline(scores, scores, changes)
    assert "| T1 | 2 | 1 | 1 | 0 | 0.500 | 1.000 | 0.667 |" in text
    logs.write_type_report(scores, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 1
