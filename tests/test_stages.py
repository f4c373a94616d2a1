"""The stages with a deterministic stand-in for the model."""

from dataclasses import replace

from changelens.config import EngineConfig
from changelens.operators import stages
from tests_data import CASE_SCHEMA, DIFF

CFG = EngineConfig(facts_sources="ast+intra", precision_mode=True, hard_block_precision=0.2, adversarial=True,
                   adversarial_with_facts=True, citation_check=True)


def model(system, user, temperature):
    if system.startswith("Name the levels"):
        return "<levels><level>method_level</level></levels>"
    if system.startswith("List the labels"):
        return ('<detected><defined><type evidence="+    amount = cost + tax">Rename Variable</type>'
                '<type evidence="-    if x == y:">Invert Condition</type></defined>'
                '<undefined><type evidence="+    amount = cost">UnknownType: a</type>'
                '<type evidence="nowhere_to_be_seen">UnknownType: b</type></undefined></detected>')
    if system.startswith("List labels that were missed"):
        assert "<candidate_missing_types>" in user and "Extract Variable" in user
        return ('<additional><type evidence="+x">Extract Variable</type><type evidence="+y">rename variable</type>'
                '<type evidence="+    amount = cost">Add Parameter</type></additional>')
    if system.startswith("Confirm"):
        return ('<verified><type confidence="95" evidence="+    amount = cost + tax">Rename Variable</type>'
                '<type confidence="85" evidence="-    if x == y:">Invert Condition</type>'
                '<type confidence="30" evidence="+    amount = cost">Add Parameter</type></verified>')
    if system.startswith("Answer KEEP"):
        assert "<intra_method_signals>" in user and "Type: Invert Condition" in user
        return "DROP not shown"
    raise AssertionError(system)


def run(spark, cfg, **kw):
    cases = spark.createDataFrame([("c1", "https://h/o/r/commit/1", DIFF, [], [], ["Rename Variable"])], CASE_SCHEMA)
    rules = spark.createDataFrame([("Rename Variable", "Add Parameter", 0.4), ("Invert Condition", "Extract Variable", 0.01)],
                                  "antecedent string, consequent string, score double")
    return stages.run_stages(cases, model, cfg, rule_rows=rules, **kw).first()


def test_all_stages(spark):
    row = run(spark, CFG)
    assert [x["type"] for x in row["stage2_defined"]] == ["Rename Variable", "Invert Condition"]
    assert [x["type"] for x in row["combined"]] == ["Rename Variable", "Invert Condition", "Add Parameter"]
    # Add Parameter fails the confidence threshold, Invert Condition the challenge, the second unknown its evidence
    assert row["final_types"] == ["Rename Variable", "UnknownType: a"]


def test_detection_only(spark):
    row = run(spark, replace(CFG, precision_mode=False, facts_sources="gone"), with_retrieval=False)
    assert row["fact_errors"] == ["unknown facts source: gone"]
    assert row["final_types"] == ["Invert Condition", "Rename Variable", "UnknownType: a", "UnknownType: b"]


def test_verdicts_by_position(spark):
    cols = "case_id string, batch int, slot int, ord int, type string, evidence string, confidence int"
    slots = spark.createDataFrame([("c", 0, i, i, t, "", 10) for i, t in enumerate("ABC")], cols)
    verdicts = spark.createDataFrame([("c", 0, 0, "KEEP ok"), ("c", 0, 1, "DROP no")], "case_id string, batch int, slot int, verdict string")
    sure = slots.where("false").drop("batch", "slot")
    got = stages.keep_certain_first(sure, slots, verdicts)
    assert sorted(r["type"] for r in got.collect()) == ["A", "C"]


def test_review_floor(spark):
    det = spark.createDataFrame([("c", i, t, "", conf) for i, (t, conf) in enumerate(
        [("A", None), ("B", 80), ("C", 60), ("D", None), ("E", 1)])], "case_id string, ord int, type string, evidence string, confidence int")
    said = spark.createDataFrame([("c", "A", "UNCERTAIN"), ("c", "B", "UNCERTAIN"), ("c", "C", "DROP"), ("c", "D", "KEEP")],
                                 "case_id string, type string, verdict string")
    assert sorted(r["type"] for r in stages.apply_review(det, said).collect()) == ["B", "D", "E"]


def test_model_failure_is_a_row(spark):
    def broken(system, user, temperature):
        raise RuntimeError("no answer")

    req = spark.createDataFrame([("c", "s", "u", 0.1)], "case_id string, system string, user string, temperature double")
    row = stages.call_model(req, broken).first()
    assert (row["reply"], row["error"], row["prompt"]) == ("", "no answer", "s\nu")


def test_repeated_calls_must_agree(spark):
    def fickle(system, user, temperature):
        if system.startswith("Name the levels"):
            return ""
        extra = '<type evidence="+z">Move Class</type>' if temperature < 0.3 else ""
        return f'<detected><defined><type evidence="+a">Add Parameter</type>{extra}</defined><undefined/></detected>'

    cases = spark.createDataFrame([("c1", "u", DIFF, [], [], [])], CASE_SCHEMA)
    row = stages.run_stages(cases, fickle, EngineConfig(detect_calls=3, disable_facts=True), with_retrieval=False).first()
    assert row["final_types"] == ["Add Parameter"]
    assert row["levels"] == ["parameter_level", "method_level", "class_level"]


def test_facts_of_several_sources_add_up(spark):
    from changelens.operators import structure

    case = ("c1", None, DIFF, [("m.py", "class A:\n    def f(self): pass\n")], [("m.py", "class A:\n    def g(self): pass\n")], ["Rename Method"])
    cases = spark.createDataFrame([case], CASE_SCHEMA)
    silent = lambda changes: structure.members(changes).where("false")
    names = lambda *sources: stages.attach_facts(cases, replace(CFG, facts_sources="+".join(sources)), {"silent": silent}).select("facts.methods_added", "facts.methods_removed").first()
    assert names("ast") == names("ast", "silent") == names("silent", "ast") == (["g"], ["f"])


EXEMPLARS = [("e1", "Extract Variable"), ("e2", "Add Parameter"), ("e3", "Rename Variable"), ("e4", "Move Method"), ("e5", "Rename Method")]


def test_requests_hold_exemplars_successful_cases_and_hints(spark, tmp_path):
    from changelens import schemas
    from changelens.sources import logs

    own = [("e3", "Rename Variable", 0.9, None, "own exemplar", "x = OWN_CODE", None, None, None, None, None, None, None)]
    cases = spark.createDataFrame([("c1", "u1", DIFF, [], [], ["Rename Variable"], own), ("c2", "u2", DIFF, [], [], [], None)],
                                  CASE_SCHEMA + f", java_examples array<{schemas.EXEMPLAR}>")
    index = spark.createDataFrame([(i, e, t, [float(i == j) + 0.1 for j in range(5)]) for i, (e, t) in enumerate(EXEMPLARS)], schemas.EXEMPLAR_INDEX)
    pool = spark.createDataFrame([(e, t, f"about {e}", f"code_of_{e}") for e, t in EXEMPLARS], "id string, refactoring_type string, description string, code_text string")
    trophies = spark.createDataFrame([("c1", [(0.9, ["Move Method"], "+won")])], "case_id string, trophies array<struct<sim:double,ground_truth:array<string>,diff_snippet:string>>")
    knowledge = stages.Knowledge(index=index, pool=pool, trophies=trophies, dim=5, confusions={"Rename Variable": "look at the scope"},
                                 hint_tables={"mined": {"Rename Variable": ["Extract Variable"]}})
    cfg = replace(CFG, precision_mode=False, adversarial=False, citation_check=False, use_trophies=True, hints_version="mined", drop_always_check=True)
    said = stages.Recorder(model)
    rows = stages.run_stages(cases, said, cfg, knowledge=knowledge)
    assert {r.case_id: r.stage3_targets for r in rows.collect()} == {"c1": ["Extract Variable"], "c2": ["Extract Variable"]}
    asked = {(r.case_id, r.stage): r.prompt for r in said.log().collect()}
    assert "x = OWN_CODE" in asked["c1", "detect"] and "OWN_CODE" not in asked["c2", "detect"]
    for case in ("c1", "c2"):  # by the case's own exemplars, or the first of the label
        assert '<for_type name="Extract Variable">' in asked[case, "missing"] and "code_of_e1" in asked[case, "missing"]
        assert "look at the scope" in asked[case, "verify"] and "code_of_e3" in asked[case, "verify"]
    assert all("+won" in asked["c1", s] and "+won" not in asked["c2", s] for s in ("detect", "missing", "verify"))
    trace = logs.case_trace(rows, said.log(), cfg)
    trace.write.json(str(tmp_path / "trace"))
    got = {r.case_id: r for r in trace.collect()}
    assert got["c1"].n_llm_calls == 4 and [c.stage for c in got["c1"].llm_calls] == ["levels", "detect", "missing", "verify"]
    assert got["c1"].trophies_chars > 0 and got["c2"].trophies_chars == 0 and got["c1"].errors == []
    assert got["c1"].stage_raw.levels[0].startswith("<levels>") and got["c1"].stage4_output and got["c1"].python_commit.url == "u1"
    assert got["c1"].java_examples_used[0].id == "e3" and got["c1"].wall_clock_total_s >= 0


def test_an_unknown_hint_version_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="v9"):
        run(spark, replace(CFG, hints_version="v9"))
