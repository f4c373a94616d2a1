"""Fixtures and brute-force checks for filters, rules, samples, sets, texts and retrieval."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens import labels as L
from changelens.config import EngineConfig, adaptive_cap
from changelens.functions import replies, text
from changelens.functions import vectors as V
from changelens.operators import context, filters, retrieval, rules, sampling, scoring, setops


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_scoring_modes(spark):
    df = spark.createDataFrame([("c", ["rename method", "Add Parameter"], ["Rename Method", "Move Class"])], "case_id string, p array<string>, g array<string>")
    got = [tuple(scoring.case_metrics(df, "p", "g", m).select("tp", "fp", "fn").first()) for m in ("normalized", "exact", "whitelist")]
    assert got == [(1, 1, 1), (0, 2, 2), (0, 1, 2)]


def test_rule_strength(spark):
    table = spark.createDataFrame([("A", "X", 0.2), ("A|B", "X", 0.4)], "antecedent string, consequent string, score double")
    sets = spark.createDataFrame([(["A", "B"],), (["A"],), (["B"],)], "labels array<string>")
    got = {tuple(r["labels"]): r["strength"] for r in rules.rule_strengths(sets, table).collect()}
    assert got == {("A", "B"): 0.4, ("A",): 0.2}


def test_candidates(spark):
    assert [adaptive_cap(n) for n in (0, 1, 2, 5, 10, 11)] == [7, 5, 5, 7, 10, 12]
    cand = rules.missing_candidates("d", "lv", EngineConfig())
    assert one(spark, cand, d=["Split Conditional"], lv=[]) == [
        "Add Parameter", "Extract Method", "Invert Condition", "Extract Subclass", "Extract Superclass", "Encapsulate Attribute", "Move And Rename Method"]
    assert one(spark, cand, d=[], lv=["parameter_level"]) == L.PARAMETER_LEVEL
    bare = rules.missing_candidates("d", "lv", EngineConfig(drop_always_check=True))
    assert one(spark, bare, d=["Split Conditional"], lv=[]) == ["Add Parameter", "Extract Method"]
    assert one(spark, rules.confusion_targets("d"), d=["Move Class", "Move Code"]) == [
        "Extract And Move Method", "Move And Rename Class", "Move And Rename Method", "Move Class"]


def test_citation(spark):
    df = spark.createDataFrame([("+def foo(bar): baz", "def foo bar"), ("+def foo(bar): baz", "def foo"), ("", "x")], "e string, t string")
    got = [(r["overlap"], r["keep"], r["missing_tokens"]) for r in filters.citation(df, "e", "t").collect()]
    assert got == [(0.75, True, ["baz"]), (0.5, False, ["bar", "baz"]), (None, True, [])]
    assert [r["keep"] for r in filters.unknown_citation(df, "e", "t").collect()] == [False, False, False]


def test_size_filters(spark):
    df = spark.createDataFrame([(i, ["T"], "x" * n) for i, n in enumerate((10, 20, 90))] + [(3, [], "x" * 999)],
                               "case_id int, refactoring_types array<string>, commit_diff string")
    assert sorted(r["case_id"] for r in filters.within_type_size(df).collect()) == [0, 1, 3]
    ex = spark.createDataFrame([("d" * 20, [("abc", "defg")])], "commit_diff string, java_examples array<struct<code_before:string,code_after:string>>")
    assert ex.select(filters.estimated_tokens("commit_diff", "java_examples")).first()[0] == 7
    assert filters.within_token_budget(ex, 10).count() == 0


def test_consensus(spark):
    votes = [("c", i, "defined", 0, t, "e") for i, ts in enumerate(("AB", "A", "AC")) for t in ts]
    votes += [("c", i, "undefined", 9, "u", "e") for i in (0, 2)]
    df = spark.createDataFrame(votes, "case_id string, call int, kind string, ord int, type string, evidence string")
    calls = spark.createDataFrame([("c", 3)], "case_id string, n_calls int")
    assert sorted((r["kind"], r["type"]) for r in setops.consensus(df, calls).collect()) == [("defined", "A"), ("undefined", "u")]


def test_collapse_and_merge(spark):
    assert sorted(one(spark, setops.collapse_compounds("t"), t=["Move And Rename Method", "Move Method", "Extract Method"])) == [
        "Extract Method", "Move And Rename Method"]
    df = spark.createDataFrame([([["Move Class", "A_b"], ["move_class", "ab", "C"]],)], "ls array<array<string>>")
    assert df.select(setops.merge_types("ls")).first()[0] == ["Move Class", "A_b", "C"]


@pytest.mark.parametrize("sizes,kept", [([5, 4, 3, 1], [5, 4]), ([5, 6, 3, 1], [5, 3, 1])])
def test_budget(spark, sizes, kept):
    df = spark.createDataFrame([(sizes,)], "s array<int>")
    assert df.select(context.fit_budget("s", lambda x: x, 9)).first()[0] == kept


def test_round_robin_equals_plain_loop(spark):
    rng = random.Random(7)
    rows = [(f"c{i}", t) for i in range(60) for t in rng.sample("ABCDE", rng.randint(1, 3))] + [(f"h{i}", "A") for i in range(200)]
    df = spark.createDataFrame(rows, "case_id string, type string")
    done = df.where("case_id in ('c1', 'c2', 'c3')").select("case_id")
    heads = df.select("case_id", "type", sampling.seeded_hash(42, "type", "case_id").alias("h")).collect()
    order = {t: [r["case_id"] for r in sorted((r for r in heads if r["type"] == t), key=lambda r: r["h"])] for t in "ABCDE"}
    seen, want, left, at = {"c1", "c2", "c3"}, [], dict.fromkeys("ABCDE", 6), dict.fromkeys("ABCDE", 0)
    while True:
        progress = False
        for t in "ABCDE":
            while left[t] and at[t] < len(order[t]):
                c = order[t][at[t]]
                at[t] += 1
                if c not in seen:
                    seen.add(c)
                    want.append((len(want), t, c))
                    left[t] -= 1
                    progress = True
                    break
        if not progress:
            break
    assert [tuple(r) for r in sampling.round_robin(df, 6, done).orderBy("round_robin_index").collect()] == want


def test_mmr_fixture(spark):
    pair = np.array([[1, .99, .1, .2], [.99, 1, .1, .3], [.1, .1, 1, .2], [.2, .3, .2, 1]])
    vecs = np.linalg.cholesky(pair)
    sims = [.9, .85, .5, .4]
    items = [(float(s), v.tolist(), i) for i, (s, v) in enumerate(zip(sims, vecs))]
    df = spark.createDataFrame([(items,)], "a array<struct<sim:double,vec:array<double>,i:int>>")
    assert [x["i"] for x in df.select(V.mmr("a", 3, 0.5)).first()[0]] == [0, 2, 3]
    assert [x["i"] for x in df.select(V.mmr("a", 3, 1.0)).first()[0]] == [0, 1, 2]
    assert [x["i"] for x in df.select(V.mmr("a", 4, 0.5)).first()[0]] == [0, 1, 2, 3]


def test_topk_paths_agree_with_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[40:70] = x[40]  # a third of the rows are copies
    names = [f"L{i % 3}" for i in range(90)]
    ix = spark.createDataFrame([(i, str(i), n, v.tolist()) for i, (n, v) in enumerate(zip(names, x))], "row_id long, id string, label string, embedding array<float>")
    q = rng.normal(size=(5, 8))
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    qs = spark.createDataFrame([(f"q{i}", v.tolist(), ["L0", "L2"]) for i, v in enumerate(q)], "query_id string, vec array<double>, targets array<string>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sims = np.round(q @ unit.T, 9)
    want = sorted((f"q{i}", r + 1, j) for i in range(5) for r, j in enumerate(
        sorted((j for j in range(90) if names[j] != "L1"), key=lambda j: (-sims[i, j], j))[:7]))

    def got():
        return sorted((r["query_id"], r["rank"], r["row_id"]) for r in retrieval.retrieve_pooled(qs, ix, 7).collect())

    assert got() == want
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 10)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 25)
    monkeypatch.setattr(retrieval, "META_BLOCKS", 3)
    assert got() == want
    free = qs.drop("targets").union(qs.selectExpr("concat(query_id, 'n')", "vec")).withColumn("targets", F.expr("IF(query_id LIKE '%n', null, array('L1'))"))
    best = {(f"q{i}{end}", j) for i in range(5) for end, of in (("", ("L1",)), ("n", ("L0", "L1", "L2")))
            for j in sorted((j for j in range(90) if names[j] in of), key=lambda j: (-sims[i, j], j))[:7]}
    assert {(r["query_id"], r["row_id"]) for r in retrieval.top_k(free, ix, 7).collect()} == best
    per = {(f"q{i}", n, j) for i in range(5) for n in ("L0", "L1", "L2")
           for j in sorted((j for j in range(90) if names[j] == n), key=lambda j: (-sims[i, j], j))[:4]}
    assert {(r["query_id"], r["label"], r["row_id"]) for r in retrieval.top_k(qs.drop("targets"), ix, 4, per_label=True).collect()} == per


def test_blocks_out_of_reach_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(50, 16)) * 0.2 for c in centres])
    ix = spark.createDataFrame([(i, str(i), f"L{i % 2}", v.tolist()) for i, v in enumerate(x)], "row_id long, id string, label string, embedding array<double>")
    q = np.stack([c / np.linalg.norm(c) for c in centres[:12]])
    qs = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, vec array<double>")
    blocks = retrieval.index_blocks(ix)
    top, pairs = retrieval.search(qs, blocks, 5)
    sims = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
    want = {(f"q{i}", j) for i in range(12) for j in sorted(range(len(x)), key=lambda j: (-sims[i, j], j))[:5]}
    assert {(r["query_id"], r["row_id"]) for r in top.collect()} == want
    assert 0 < pairs.count() < 0.25 * 12 * blocks.count()
    assert {(r["query_id"], r["row_id"]) for r in retrieval.top_k(qs, blocks, 5).collect()} == want  # a stored index, used again


def test_more_queries_than_a_block(spark):
    ix = spark.range(300).selectExpr("id AS row_id", "'L' AS label", "array(CAST(cos(id) AS FLOAT), CAST(sin(id) AS FLOAT)) AS embedding")
    qs = spark.range(5000).selectExpr("CAST(id AS STRING) AS query_id", "array(cos(id * 7D), sin(id * 7D)) AS vec")
    top = retrieval.top_k(qs, ix, 1)
    got = {int(r["query_id"]): r["row_id"] for r in top.collect()}
    a, b = np.arange(5000) * 7.0, np.arange(300).astype(float)
    x = np.stack([np.cos(b), np.sin(b)], 1).astype(np.float32).astype(float)
    sims = np.round(np.stack([np.cos(a), np.sin(a)], 1) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
    assert got == dict(enumerate(sims.argmax(axis=1).tolist()))


def test_replies(spark):
    block = '<defined><type evidence="+a">X</type><type evidence="+b">x</type></defined>'
    df = spark.createDataFrame([(block,)], "t string")
    assert [tuple(x) for x in df.select(replies.parse_block("t", "defined")).first()[0]] == [("X", "+a")]
    conf = '<verified><type confidence="85" evidence="+a">Add Parameter</type><type evidence="-b">Move Class</type></verified>'
    assert one(spark, replies.parse_confidences("t"), t=conf) == {"Add Parameter": 85}
    assert one(spark, replies.repair("t"), t='<think>x</think><type evidence="+a"Add Parameter</type>') == '<type evidence="+a">Add Parameter</type>'
    assert one(spark, replies.parse_levels("t"), t="the class_level and <level> Method_Level </level>") == ["Method_Level"]
    assert one(spark, replies.parse_levels("t"), t="class_level, parameter_level") == ["parameter_level", "class_level"]
    assert one(spark, F.size(replies.parse_block("t", "defined")), t="<defined/> <type>Z</type>") == 0
    plain = one(spark, replies.parse_block("t", "defined"), t="<defined><type>None</type><type> 'Z' </type></defined>")
    assert [tuple(x) for x in plain] == [("Z", "")]
    assert one(spark, replies.parse_review("t"), t="A | keep | r\nB|DROP\nA | UNCERTAIN | x\nnoise") == {"A": "UNCERTAIN", "B": "DROP"}


def test_texts(spark):
    assert one(spark, text.case_key(F.lit(None).cast("string"), "u", "d"), u="https://h/o/r/commit/1", d="x") == "https___h_o_r_commit_1"
    py = '"""doc\n# x"""\nx = "#a" # c\ny = \'it\\\'s #1\'  # d\n\n\n\nz = "open # \\'
    assert one(spark, text.clean_python("c"), c=py) == 'x = "#a"\ny = \'it\\\'s #1\'\n\nz = "open # \\'
    assert one(spark, text.clean_java("c"), c="a; // x\n/* m\nn */b;  \n\n\n\nc;") == "a;\nb;\n\nc;"
    assert one(spark, text.drop_comment_lines("c"), c="  // x\na; // y\r\n//z") == "a; // y"
    parts = one(spark, text.split_code_text("c"), c="BEFORE:\nx\n\nAFTER:\ny\n\nAFTER:\nz")
    assert tuple(parts) == ("x", "y\n\nAFTER:\nz")
    assert tuple(one(spark, text.split_code_text("c"), c="AFTER:\ny")) == ("", "y")
    assert one(spark, text.identifiers("c"), c="naïve_x größe abc 9z _q1") == ["abc", "_q1"]
    assert one(spark, text.parse_type_list("c"), c=" A, none ,B,, N/A") == ["A", "B"]
    assert one(spark, text.clean_exemplar_before("c"), c="[T] d\n\nBEFORE:\n// FILE: p\nx; /* y */") == "[T] d\n\nBEFORE:\nx;"
    assert one(spark, filters.call_site_present("n", "d"), n="f", d="+def f():\n-f(1)\n+x = f (2)") is True
    assert one(spark, filters.call_site_present("n", "d"), n="f", d="+def f(a):\n-f(1)") is False


def test_gate_modes(spark):
    def reason(mode):
        return one(spark, filters.addition_reason("t", "s", F.lit(0.5), "k", "g", mode=mode), t="Extract Class", s=[], k=["added"], g=[])

    assert reason("intended") is None and reason("literal") == "class_level_no_struct"
    weak = filters.addition_reason("t", "s", F.lit(0.01), "k", "g")
    assert one(spark, weak, t="Move Class", s=[], k=[], g=[]) == "rule_strength<tau"
    assert one(spark, weak, t="Move Class", s=["Move Class"], k=[], g=[]) is None


def test_plans_stay_in_the_jvm(spark):
    from changelens.plans import registry

    python = {"exemplar_topk_by_label"}
    for name in ("multilabel_micro_prf", "run_pairing", "citation_overlap", "cooccurrence_npmi", "reply_two_step"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan, name
        assert "CartesianProduct" not in plan, name
    assert python <= set(registry.QUERIES)


def test_config():
    cfg = EngineConfig.from_env(env={"CHANGELENS_PRECISION_MODE": "1", "CHANGELENS_MISSING_CAP": "0", "CHANGELENS_REVIEW_FLOOR": "x"})
    assert cfg.precision_mode and cfg.missing_cap == 1 and cfg.review_floor == 70 and cfg.suppress_thinking


def test_glossary(spark):
    defs = spark.createDataFrame([("Add Parameter", "adds")], "type string, definition string")
    terms = spark.createDataFrame([("Add", "action", "a"), ("Parameter", "target", "p"), ("Pull Up", "action", "u")], "term string, role string, text string")
    notes = spark.createDataFrame([], "type string, note string")
    got = {r["level"]: r["reference_xml"] for r in context.level_glossary(defs, terms, notes).collect()}
    assert '<definition type="Add Parameter">adds</definition>' in got["parameter_level"]
    assert '<term name="Pull Up" role="action">u</term>' in got["class_level"] and "Pull Up" not in got["parameter_level"]
