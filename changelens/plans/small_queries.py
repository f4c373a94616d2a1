"""Queries for operators of one row: parts of prompts and replies, and the log of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens import labels as L
from changelens.functions import replies as P
from changelens.functions import text as X
from changelens.operators import context as C
from changelens.operators import retrieval as R
from changelens.operators import scoring
from changelens.plans import derived as D
from changelens.plans.derived import runs, table
from changelens.plans.label_queries import _rounded, status_sql
from changelens.plans.session import checkpoint_dir
from changelens.sources import external, logs

_STATUS = "CASE WHEN CAST(case_id AS BIGINT) % 7 = 0 THEN 'ERROR' WHEN CAST(case_id AS BIGINT) % 5 = 0 THEN 'SKIPPED' ELSE 'OK' END"
_LEVELS = ("concat('<levels>', CASE WHEN o_orderstatus = 'F' THEN '<level> class_level </level><level>nonsense</level><LEVEL>method_level</LEVEL>' "
           "WHEN o_orderpriority < '3' THEN 'perhaps class_level or Parameter_Level' ELSE '<think><level>class_level</level></think>none' END, '</levels>')")
_DUMP = ("concat('Module [0,9]', chr(10), '    ClassDef: C', o_custkey, ' [1,8]', chr(10), '        FunctionDef: f [2,', o_orderkey, ']', chr(10), "
         "'            Name: x [3,4]', chr(10), CASE WHEN o_orderstatus = 'F' THEN concat('        FunctionDef: g [5,6]', chr(10)) ELSE '' END, 'not a node', chr(10), '    Pass [8,9]')")


def status_scores(spark, d):
    """Micro scores with failed and skipped cases: a failed one adds its misses, a skipped one nothing."""
    scored = scoring.case_metrics(runs(spark, d).withColumn("status", F.expr(_STATUS)), "predicted", "truth")
    return _rounded(scoring.micro(scored, "track"), "track", "n", "skipped", "tp", "fp", "fn", "p", "r", "f1")


def level_replies(spark, d):
    """Levels named in replies: tags first, without tags every level that is mentioned."""
    r = table(spark, d, "orders").select("o_orderkey", F.expr(_LEVELS).alias("reply"))
    return r.select("o_orderkey", F.array_join(F.array_sort(P.parse_levels("reply")), ",").alias("levels"))


def code_text_split(spark, d):
    """Conversation texts as before/after blobs in all their forms, taken apart."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.expr(
        "CASE turn % 4 WHEN 0 THEN concat('BEFORE:\\n', text, '\\n\\nAFTER:\\n', role) WHEN 1 THEN concat('BEFORE:\\n', text) "
        "WHEN 2 THEN concat('AFTER:\\n', text) ELSE text END").alias("blob"))
    parts = X.split_code_text("blob")
    return t.select("conv_id", "turn", F.md5(parts["code_before"]).alias("before_md5"), F.md5(parts["code_after"]).alias("after_md5"))


def anchor_ids(spark, d):
    """Ids of each conversation's turns as exemplars, those without an id left out."""
    ex = F.struct(F.when(F.col("turn") % 3 > 0, F.concat_ws("-", "conv_id", "turn")).otherwise(F.when(F.col("turn") > 0, "")).alias("id"))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", ex.alias("x")))), lambda s: s["x"]).alias("ex"))
    return lists.select("conv_id", F.array_join(R.anchor_ids(F.col("ex")), ",").alias("ids"))


def exemplar_summary(spark, d):
    """The first five turns of each conversation as exemplars, texts cut to 40 characters and marked."""
    ex = F.struct("turn", F.struct(
        F.col("turn").cast("string").alias("id"), F.col("role").alias("refactoring_type"), F.lit(0.5).alias("similarity"),
        F.lit(None).cast("double").alias("rerank_score"), F.lit("u").alias("url"), F.col("text").alias("code_text")).alias("x"))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(ex)), lambda s: s["x"]).alias("ex"))
    short = F.transform(C.summarize_exemplars("ex", 5, 40), lambda s: F.concat_ws(":", s["id"], s["refactoring_type"], s["code_text_truncated"]))
    return lists.select("conv_id", F.size(short).cast("bigint").alias("n"), F.md5(F.array_join(short, "\n")).alias("md5"))


def log_counts(spark, d):
    """A run's log written and read again with a broken and a blank line: finished cases per scheduled label."""
    import uuid

    path = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    done = runs(spark, d).select(
        "case_id", F.lit(None).cast("string").alias("url"), F.col("predicted").alias("final_types"), F.col("truth").alias("refactoring_types"),
        F.element_at("truth", 1).alias("scheduled_for_type"))
    logs.append_log(logs.case_record(done), path)
    spark.createDataFrame([("{broken",), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    return logs.finished_per_type(logs.read_log(spark, path))


def tree_children(spark, d):
    """Members one level below each class of an indented tree dump."""
    t = table(spark, d, "orders").select("o_orderkey", F.explode(external.subtrees(F.expr(_DUMP), "ClassDef")).alias("sub"))
    below = external.children(F.col("sub"), "FunctionDef")
    return t.select("o_orderkey", F.size(external.dump_rows(F.col("sub"))).cast("bigint").alias("n_rows"),
                    F.array_join(F.transform(below, lambda r: F.concat_ws(":", r["value"], r["end"])), ",").alias("methods"))


def level_reference(spark, d):
    """Definitions and terms of each level from tables of part names."""
    parts = table(spark, d, "part").agg(F.count("*").alias("n"), F.max("p_size").alias("s"))
    types = [t for names in L.LEVELS.values() for t in names]
    defs = parts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.concat(F.lit(f"{t} of "), F.col("n").cast("string")).alias("definition")) for t in types])).alias("x")).select("x.*")
    terms = parts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(w).alias("term"), F.concat(F.lit(f"{w} "), F.col("s").cast("string")).alias("text")) for r, w in _TERMS])).alias("x")).select("x.*")
    notes = parts.select(F.lit("Split Conditional").alias("type"), F.lit("in two").alias("note"))
    return C.level_glossary(defs, terms, notes).select("level", F.md5("reference_xml").alias("md5"))


def case_summaries(spark, d):
    """The five telling fields of every derived case; fields it lacks are empty."""
    c = D.cases(spark, d)
    s = c.select("case_id", C.case_summary(c).alias("s"))
    return s.select("case_id", "s.url", "s.repository", "s.sha1", F.array_join("s.refactoring_types", "|").alias("types"), F.md5("s.commit_diff").alias("diff_md5"))


_TERMS = [("action", "Extract"), ("action", "Move"), ("target", "Class"), ("target", "Method"), ("target", "Parameter"), ("action", "absent")]


QUERIES = {f.__name__: f for f in (
    status_scores, level_replies, code_text_split, anchor_ids, exemplar_summary, log_counts, tree_children, level_reference, case_summaries)}


def _level_sql() -> str:
    rows = []
    for level, names in L.LEVELS.items():
        values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
        rows.append(f"SELECT '{level}' AS level, * FROM (VALUES {values}) v(ord, type)")
    terms = ", ".join(f"('{r}', '{w}')" for r, w in _TERMS)
    return f"""WITH t AS ({" UNION ALL ".join(rows)}), p AS (SELECT count(*) AS n, max(p_size) AS s FROM part), g(role, term) AS (VALUES {terms}),
u AS (SELECT DISTINCT level, role, term FROM t JOIN g ON contains(' ' || replace(type, ' And ', ' ') || ' ', ' ' || term || ' ')),
l AS (SELECT DISTINCT level FROM t),
a AS (SELECT level, '  <type_definitions>' || chr(10) || string_agg('    <definition type="' || type || '">' || type || ' of ' || n || '</definition>', chr(10) ORDER BY ord) || chr(10) || '  </type_definitions>' AS x FROM t, p GROUP BY level),
b AS (SELECT level, '  <term_glossary>' || chr(10) || string_agg('    <term name="' || term || '" role="' || role || '">' || term || ' ' || s || '</term>', chr(10) ORDER BY role, term) || chr(10) || '  </term_glossary>' AS x FROM u, p GROUP BY level),
c AS (SELECT level, '  <compound_types>' || chr(10) || '    <compound type="Split Conditional">in two</compound>' || chr(10) || '  </compound_types>' AS x FROM t WHERE type = 'Split Conditional')
SELECT l.level, md5(concat_ws(chr(10), '<reference>', a.x, b.x, c.x, '</reference>')) AS md5 FROM l LEFT JOIN a USING (level) LEFT JOIN b USING (level) LEFT JOIN c USING (level)"""


ORACLE = {
    "status_scores": status_sql(_STATUS),
    "level_replies": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'class_level,method_level' WHEN o_orderpriority < '3' THEN 'class_level,parameter_level' ELSE '' END AS levels FROM orders""",
    "code_text_split": """SELECT conv_id, turn, md5(CASE turn % 4 WHEN 2 THEN '' ELSE text END) AS before_md5, md5(CASE turn % 4 WHEN 0 THEN role WHEN 2 THEN text ELSE '' END) AS after_md5 FROM conversations""",
    "anchor_ids": """SELECT conv_id, coalesce(string_agg(conv_id || '-' || turn, ',' ORDER BY turn) FILTER (turn % 3 > 0), '') AS ids FROM conversations GROUP BY conv_id""",
    "exemplar_summary": """SELECT conv_id, count(*) AS n, md5(string_agg(turn || ':' || role || ':' || CASE WHEN length(text) > 40 THEN left(text, 40) || '...[truncated]' ELSE text END, chr(10) ORDER BY turn)) AS md5
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE i <= 5 GROUP BY conv_id""",
    "log_counts": f"WITH {D.DUCK_RUNS} SELECT truth[1] AS type, count(*) AS n FROM runs WHERE truth[1] <> '' GROUP BY 1",
    "tree_children": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END::BIGINT AS n_rows, 'f:' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ',g:6' ELSE '' END AS methods FROM orders""",
    "level_reference": _level_sql(),
    "case_summaries": f"SELECT CAST(o_orderkey AS VARCHAR) AS case_id, {D.URL} AS url, '' AS repository, '' AS sha1, array_to_string({D.duck_labels(D.TRUTH)}, '|') AS types, md5({D.DIFF}) AS diff_md5 FROM orders",
}
