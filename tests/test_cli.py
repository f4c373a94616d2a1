import json

from changelens import cli
from changelens.sources import logs


def test_clean_and_schedule(spark, tmp_path, capsys):
    items = [{"refactoring_types": ["Move Class", "Odd Label"], "commit_diff": "-x", "url": f"u{i}",
              "code_before": [{"file": "a.py", "code": "x = 1  # c"}], "code_after": []} for i in range(4)]
    src = tmp_path / "c.json"
    src.write_text(json.dumps(items))
    cli.main(["clean", "--input", str(src), "--output", str(tmp_path / "clean")], spark)
    assert "code chars: 40 -> 20 (50.0% reduction)" in capsys.readouterr().out
    log = tmp_path / "log"
    log.mkdir()
    (log / "l.json").write_text('{"case_id":"u0","scheduled_for_type":"Move Class"}\n')
    cli.main(["schedule", "--input", str(src), "--log", str(log), "--per-type", "3", "--known-only", "--output", str(tmp_path / "todo")], spark)
    got = spark.read.json(str(tmp_path / "todo")).collect()
    assert len(got) == 2 and {r["scheduled_for_type"] for r in got} == {"Move Class"} and "u0" not in {r["case_id"] for r in got}


def test_score(spark, tmp_path, capsys):
    for track, final in (("base", ["Move Class"]), ("new", ["Move Class", "Add Parameter"]), ("cut", [])):
        rows = [(f"c{i}", final, ["Move Class"]) for i in range(2 if track != "cut" else 1)]
        logs.append_log(spark.createDataFrame(rows, "case_id string, final_known array<string>, ground_truth_known array<string>"), str(tmp_path / track))
    cli.main(["score", "--root", str(tmp_path), "--tracks", "base", "new", "cut", "gone", "--stopped", "cut", "--base", "base",
              "--output", str(tmp_path / "out")], spark)
    text = capsys.readouterr().out
    assert "| base | 2 | 2 | 0 | 0 | 1.000 | 1.000 | 1.000 |" in text and "| new | -0.500 | 0.000 |" in text
    report = spark.read.option("header", True).csv(str(tmp_path / "out" / "per_type"))
    assert report.count() == 3 * 39
