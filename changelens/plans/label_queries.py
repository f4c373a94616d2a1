"""Scores of labelled runs, rules between labels, and ingest of case records."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens import labels as L
from changelens.config import EngineConfig
from changelens.functions import text as X
from changelens.functions.rows import pos_rows, rows
from changelens.operators import filters, rules, scoring
from changelens.plans import derived as D
from changelens.plans.derived import runs, table
from changelens.sources import cases as ingest, logs

# Scores

_RATES = ["p", "r", "f1"]


def _rounded(df, *cols):
    return df.select(*[F.round(c, 9).alias(c) if c in (*_RATES, "d_p", "d_r", "d_f1") else c for c in cols])


def multilabel_micro_prf(spark, d):
    scored = scoring.case_metrics(runs(spark, d), "predicted", "truth")
    return _rounded(scoring.micro(scored, "track"), "track", "n", "tp", "fp", "fn", *_RATES)


def exact_case_score(spark, d):
    """Scores of each case as written, unknown labels of the truth included."""
    return scoring.case_metrics(runs(spark, d), "predicted", "truth", "exact").select(
        "case_id", "track", *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")],
        F.array_join(F.array_sort("missed"), "|").alias("missed"), F.array_join(F.array_sort("false_alarms"), "|").alias("false_alarms"))


def track_scores(spark, d):
    return _rounded(scoring.track_scores(runs(spark, d), "predicted", "truth"), "track", "n", "tp", "fp", "fn", *_RATES)


def per_type_confusion(spark, d):
    return scoring.per_type(runs(spark, d), "predicted", "truth").select("type", "tp", "fp", "fn", "tn", "precision", "recall", "accuracy", "f1")


def macro_accuracy(spark, d):
    per = scoring.per_type(runs(spark, d), "predicted", "truth")
    return scoring.macro_accuracy(per).select(F.round("macro_accuracy", 6).alias("macro_accuracy"))


def paired_track_delta(spark, d):
    out = scoring.deltas(scoring.shared_track_scores(runs(spark, d), "predicted", "truth", ["base", "checked"]), "base")
    return _rounded(out, "track", "d_p", "d_r", "d_f1")


def best_track(spark, d):
    scores = scoring.track_scores(runs(spark, d), "predicted", "truth")
    parts = [scoring.best_track(scores, m).select(F.lit(m).alias("metric"), "track") for m in ("f1", "p", "r")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def type_report(spark, d):
    counts = scoring.type_counts(runs(spark, d), "predicted", "truth", "track")
    return scoring.type_report(counts, "track").select("track", "type", "tp", "fp", "fn", "precision", "recall", "f1")


def undefined_labels(spark, d):
    return scoring.undefined_counts(runs(spark, d), "predicted")


def event_tracks(spark, d):
    """Event types as runs over users: positive values are hits; users seen by every type are compared."""
    e = table(spark, d, "events").select(F.col("event_type").alias("track"), F.col("user_id").alias("case_id"), "value")
    shared = scoring.paired_cases(e)
    return shared.groupBy("track").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("n_high"))


# History gates

def _detections(spark, d):
    """Each predicted label of every run with a confidence (none for some)."""
    return pos_rows(runs(spark, d), "predicted", "case_id", "track", names=("ord", "type")).withColumn(
        "confidence", F.when(F.col("ord") > 0, F.length("case_id") * 20 + F.col("ord")))


def _history(spark, d):
    return filters.precision_history(scoring.type_counts(runs(spark, d), "predicted", "truth", mode="exact"))


def label_history(spark, d):
    return _history(spark, d).select("type", "support", F.round("precision", 9).alias("precision"))


def confidence_hard_block(spark, d):
    out = filters.confidence_gate(_detections(spark, d), _history(spark, d), hard_floor=0.30, threshold=80)
    return out.select("case_id", "track", "type", "confidence", "reason")


def candidate_floor(spark, d):
    out = filters.candidate_floor(_detections(spark, d), _history(spark, d), floor=0.5)
    return out.select("case_id", "track", "type", "reason")


# Rules

def _baskets(spark, d):
    """Brands of each order: the label sets."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("label")), "l_partkey")
    return items.select(F.col("l_orderkey").alias("case_id"), "label")


def _sets(spark, d):
    return rules.label_sets(_baskets(spark, d))


def cooccurrence_npmi(spark, d):
    return rules.pair_stats(_sets(spark, d)).select(
        "a", "b", "n_ab", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift", "npmi")])


def mined_hints(spark, d):
    stats = rules.pair_stats(_sets(spark, d))
    parts = [rules.mine_hints(stats, by).select(F.lit(v).alias("version"), "src", F.col("ord").cast("bigint").alias("ord"), "dst")
             for v, by in (("count", "n_ab"), ("npmi", "npmi"), ("rule", "score"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def association_rules(spark, d):
    return rules.association_rules(_sets(spark, d)).select(
        "antecedent", "consequent", "n_xc", *[F.round(c, 10).alias(c) for c in ("confidence", "lift", "score")])


def _small_sets(spark, d):
    """Return flags, statuses and priorities of each order's lines: a small label space."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    flags = li.select(F.col("l_orderkey").alias("case_id"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("label"))
    prio = o.select(F.col("o_orderkey").alias("case_id"), F.explode(F.array("o_orderpriority", F.lower("o_orderstatus"))).alias("label"))
    return rules.label_sets(flags.unionByName(prio))


def rule_strength_max(spark, d):
    sets = _small_sets(spark, d)
    out = rules.rule_strengths(sets, rules.association_rules(sets))
    return out.select(F.array_join("labels", "|").alias("labels"), "target", F.round("strength", 6).alias("strength"))


def scored_candidates(spark, d):
    sets = _small_sets(spark, d)
    singles = rules.itemset_counts(sets, 1).select(F.col("items")[0].alias("type"), "n")
    total = sets.agg(F.sum("n").alias("n_cases"))
    priors = singles.select("type", (F.col("n") / total.scalar()).alias("prior"))
    flat = priors.select("type", F.lit(0.1).alias("prior"))
    out = rules.scored_candidates(rules.rule_strengths(sets, rules.association_rules(sets)), sets, priors, flat, priors, 1.0, 0.5, 0.25, 5)
    return out.select(F.array_join("labels", "|").alias("labels"), "target", "rank")


def vote_candidates(spark, d):
    """Brands that go with the brands of each order, by the mined count table."""
    hints = rules.mine_hints(rules.pair_stats(_sets(spark, d)))
    found = _baskets(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    backup = ["Brand#1", "Brand#2"]
    return rules.voted_by_edges(found, hints, 7, always=backup).select("case_id", F.array_join("candidates", "|").alias("candidates"))


def missing_candidates(spark, d):
    """Candidate labels of every run under the curated hints; nothing detected offers whole levels."""
    r = runs(spark, d)
    known = F.filter("predicted", X.is_known_type)
    levels = F.array(F.when(F.col("track") == "base", "parameter_level").otherwise("class_level"))
    cand = rules.missing_candidates("known", "levels", EngineConfig())
    out = r.withColumn("known", known).withColumn("levels", levels)
    return out.select("case_id", "track", F.array_join(cand, "|").alias("candidates"))


def confusion_targets(spark, d):
    r = runs(spark, d)
    return r.select("case_id", "track", F.array_join(rules.confusion_targets("predicted"), "|").alias("targets"))


def level_rollup(spark, d):
    """Predicted labels per level."""
    r = rows(runs(spark, d), "predicted", "track", name="type")
    return r.groupBy("track", F.coalesce(X.level_of("type"), F.lit("none")).alias("level")).agg(F.count("*").alias("n"))


def definition_lookup(spark, d):
    """Part types looked up by exact name, then ignoring case and blanks."""
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.lower("p_type")).otherwise(F.col("p_type")).alias("name"))
    book = table(spark, d, "part").groupBy(F.col("p_type").alias("k")).agg(F.max("p_size").cast("string").alias("text"))
    return rules.lookup(parts, "name", book, "k", "text").select("p_partkey", "name", "found_key", "text")


# Ingest

_EX = "named_struct('id', '{id}', 'refactoring_type', 'Move Class', 'similarity', {sim}, 'description', 'd', 'code_before', '/* c */ a;', 'code_after', 'b; // x')"


def _records(spark, d):
    """Every order as a JSON record in one of the four layouts, by priority."""
    orders = D.spread(table(spark, d, "orders"))
    files = lambda code: f"array(named_struct('file', 'm.py', 'code', {code}))"
    ex = lambda i, s: _EX.format(id=i, sim=s)
    new = f"""to_json(named_struct('url', url, 'repository', 'r', 'sha1', 's', 'code_before', {files('before')}, 'code_after', {files('after')},
      'refactorings', array(named_struct('type', 'Move Class', 'matched_java_examples', array({ex('x', 0.5)}, {ex('y', 0.4)})),
      named_struct('type', '', 'matched_java_examples', array({ex('x', 0.9)})))))"""
    old = f"to_json(named_struct('python_refactoring', named_struct('url', url, 'code_before', {files('before')}, 'code_after', {files('after')}, 'refactoring_type', 'Move Class'), 'java_examples', array({ex('x', 0.5)})))"
    flat = f"to_json(named_struct('url', '', 'refactoring_type', 'Move Class', 'code_before', before, 'code_after', after, 'matched_java_examples', array({ex('x', 0.5)})))"
    commit = "to_json(named_struct('url', url, 'commit_diff', diff, 'refactoring_types', array('Move Class', 'Add Parameter'), 'matched_java_examples', array()))"
    base = orders.select("o_orderkey", "o_orderpriority", F.expr(D.URL).alias("url"), F.expr(D.DIFF).alias("diff"),
                         F.expr(D.BEFORE_MAIN).alias("before"), F.expr(D.AFTER_MAIN).alias("after"))
    layout = f"CASE WHEN o_orderpriority < '2' THEN {new} WHEN o_orderpriority < '3' THEN {old} WHEN o_orderpriority < '4' THEN {flat} ELSE {commit} END"
    return base.select("o_orderkey", F.expr(layout).alias("json"))


def _ingested(spark, d):
    return ingest.parse_cases(_records(spark, d), "json", "o_orderkey")


def ingest_layouts(spark, d):
    return _ingested(spark, d).select(
        "o_orderkey", "fmt", "case_id", "url", F.array_join("refactoring_types", "|").alias("types"), F.md5("commit_diff").alias("diff_md5"),
        F.size("code_before").cast("bigint").alias("n_before"), F.array_join(F.transform(
            "java_examples", lambda x: F.concat_ws(":", x["id"], x["similarity"].cast("string"))), "|").alias("exemplars"))


def clean_totals(spark, d):
    """Characters before and after cleaning every code field, per layout."""
    out = ingest.clean_cases(_ingested(spark, d))
    return out.groupBy("fmt").agg(F.count("*").alias("n"), F.sum("chars_before").alias("chars_before"), F.sum("chars_after").alias("chars_after"))


def case_records(spark, d):
    r = runs(spark, d).select(
        F.concat("track", F.lit("/"), "case_id").alias("case_id"), F.lit("").alias("url"), F.col("predicted").alias("final_types"), F.col("truth").alias("refactoring_types"))
    return logs.case_record(r).select("case_id", F.array_join("final_known", "|").alias("final_known"),
                                      F.array_join("final_undefined", "|").alias("final_undefined"),
                                      *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])


QUERIES = {f.__name__: f for f in (
    multilabel_micro_prf, exact_case_score, track_scores, per_type_confusion, macro_accuracy, paired_track_delta, best_track, type_report,
    undefined_labels, event_tracks, label_history, confidence_hard_block, candidate_floor, cooccurrence_npmi, mined_hints,
    association_rules, rule_strength_max, scored_candidates, vote_candidates, missing_candidates, confusion_targets, level_rollup,
    definition_lookup, ingest_layouts, clean_totals, case_records)}

# Oracle side

_KNOWN = ", ".join(f"'{t.lower()}'" for t in L.KNOWN_TYPES)
_EXACT = ", ".join(f"'{t}'" for t in L.KNOWN_TYPES)
_NORM = r"lower(regexp_replace(trim({}), '\s+', ' ', 'g'))"
_ROWS = D.DUCK_RUNS + f""",
pr AS (SELECT DISTINCT case_id, track, unnest(predicted) AS t FROM runs),
gt AS (SELECT DISTINCT case_id, track, unnest(truth) AS t FROM runs),
pn AS (SELECT case_id, track, t, {_NORM.format('t')} AS k FROM pr WHERE {_NORM.format('t')} IN ({_KNOWN})),
gn AS (SELECT case_id, track, t, {_NORM.format('t')} AS k FROM gt WHERE {_NORM.format('t')} IN ({_KNOWN})),
px AS (SELECT * FROM pr WHERE t IN ({_EXACT})), gx AS (SELECT * FROM gt WHERE t IN ({_EXACT})),
pe AS (SELECT * FROM pr WHERE t NOT LIKE 'UnknownType%')"""


def _counts(p: str, g: str, key: str, by: str) -> str:
    """tp, fp and fn by a full join of prediction and truth rows."""
    return f"""SELECT {by}, count(*) FILTER (a.case_id IS NOT NULL AND b.case_id IS NOT NULL) AS tp, count(*) FILTER (b.case_id IS NULL) AS fp,
count(*) FILTER (a.case_id IS NULL) AS fn FROM {p} a FULL JOIN {g} b ON a.case_id = b.case_id AND a.track = b.track AND a.{key} = b.{key} GROUP BY ALL"""


def _div(a, b):
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0 END"


_PRF = f"""round({_div('tp', 'tp + fp')}, 9) AS p, round({_div('tp', 'tp + fn')}, 9) AS r, round({_div('2.0 * tp', '2 * tp + fp + fn')}, 9) AS f1"""
def status_sql(status: str) -> str:
    """Micro scores where a status per case decides what counts."""
    return f"""WITH {_ROWS}, st AS (SELECT case_id, track, {status} AS status FROM runs),
pok AS (SELECT pn.* FROM pn JOIN st USING (case_id, track) WHERE status = 'OK'), gok AS (SELECT gn.* FROM gn JOIN st USING (case_id, track) WHERE status = 'OK'),
s AS ({_counts('pok', 'gok', 'k', "coalesce(a.track, b.track) AS track")}),
e AS (SELECT g.track, count(*) AS more FROM gn g JOIN st USING (case_id, track) ANTI JOIN pn p ON p.case_id = g.case_id AND p.track = g.track AND p.k = g.k WHERE status = 'ERROR' GROUP BY 1),
n AS (SELECT track, count(*) AS n, count(*) FILTER (status = 'SKIPPED') AS skipped FROM st GROUP BY track),
f AS (SELECT track, n, skipped, tp, fp, s.fn + coalesce(more, 0) AS fn FROM n JOIN s USING (track) LEFT JOIN e USING (track))
SELECT track, n, skipped, tp, fp, fn, {_PRF} FROM f"""


_BY_TRACK = "coalesce(a.track, b.track) AS track"
_N = "n AS (SELECT track, count(*) AS n FROM runs GROUP BY track)"
_SHARED = """common AS (SELECT case_id FROM runs WHERE track IN ('base', 'checked') GROUP BY case_id HAVING count(DISTINCT track) = 2)"""
_TRACKS = f"WITH {_ROWS}, s AS ({_counts('px', 'gx', 't', _BY_TRACK)}), {_N} SELECT track, n, tp, fp, fn, {_PRF} FROM s JOIN n USING (track)"
_HIST = f"""h0 AS ({_counts('pe', 'gt', 't', 'coalesce(a.t, b.t) AS type')}),
hist AS (SELECT type, tp + fp AS support, tp / (tp + fp) AS p FROM h0 WHERE tp + fp > 0)"""
_DET = """det AS (SELECT case_id, track, unnest(predicted) AS type, generate_subscripts(predicted, 1) - 1 AS ord FROM runs),
det2 AS (SELECT case_id, track, type, CASE WHEN ord > 0 THEN length(case_id) * 20 + ord END AS confidence FROM det)"""
_BASK = """bask AS (SELECT DISTINCT l_orderkey AS c, p_brand AS l FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_SMALL = """bask AS (SELECT DISTINCT c, l FROM (SELECT l_orderkey AS c, l_returnflag AS l FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem
UNION ALL SELECT o_orderkey, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, lower(o_orderstatus) FROM orders))"""
_STATS = """n AS (SELECT count(DISTINCT c) AS n FROM bask), s AS (SELECT l, count(*) AS k FROM bask GROUP BY l),
j AS (SELECT x.l AS a, y.l AS b, count(*) AS n_ab FROM bask x JOIN bask y ON x.c = y.c AND x.l <> y.l GROUP BY ALL),
st AS (SELECT a, b, n_ab, n_ab / n.n AS support, n_ab / sa.k AS confidence, n_ab * n.n / (sa.k * sb.k) AS lift,
CASE WHEN n_ab < n.n THEN ln(n_ab * n.n / (sa.k * sb.k)) / -ln(n_ab / n.n) ELSE 1.0 END AS npmi FROM j JOIN s sa ON a = sa.l JOIN s sb ON b = sb.l, n)"""
_RULES = """r1 AS (SELECT x.l AS antecedent, z.l AS consequent, count(*) AS n_xc FROM bask x JOIN bask z ON x.c = z.c AND x.l <> z.l GROUP BY ALL),
r2 AS (SELECT x.l || '|' || y.l AS antecedent, z.l AS consequent, count(*) AS n_xc FROM bask x JOIN bask y ON x.c = y.c AND x.l < y.l
JOIN bask z ON x.c = z.c AND z.l <> x.l AND z.l <> y.l GROUP BY ALL),
lhs AS (SELECT l AS antecedent, k AS n_x FROM s UNION ALL
SELECT x.l || '|' || y.l, count(*) FROM bask x JOIN bask y ON x.c = y.c AND x.l < y.l GROUP BY 1),
rules AS (SELECT antecedent, consequent, n_xc, n_xc / n_x AS confidence, n_xc * n.n / (n_x * s.k) AS lift, (n_xc * n.n / (n_x * s.k)) * (n_xc / n_x) AS score
FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) JOIN lhs USING (antecedent) JOIN s ON consequent = s.l, n)"""
_STRENGTH = """sets AS (SELECT DISTINCT string_agg(l, '|' ORDER BY l) AS labels FROM bask GROUP BY c),
parts AS (SELECT labels, unnest(string_split(labels, '|')) AS l FROM sets),
keys AS (SELECT labels, l AS antecedent FROM parts UNION ALL SELECT x.labels, x.l || '|' || y.l FROM parts x JOIN parts y ON x.labels = y.labels AND x.l < y.l),
str AS (SELECT labels, consequent AS target, max(score) AS strength FROM keys JOIN rules USING (antecedent) GROUP BY ALL)"""
_RULE_BASE = f"WITH {_SMALL}, {_STATS}, {_RULES}, {_STRENGTH}"
_HINT_ROWS = ", ".join(f"('{s}', '{t}')" for s, ts in L.CURATED_HINTS.items() for t in ts)
_BACKUP_ROWS = ", ".join(f"('{t}', {i})" for i, t in enumerate(L.ALWAYS_CHECK))


def _hints_cte(order: str, name: str) -> str:
    return f"{name} AS (SELECT a AS src, b AS dst, row_number() OVER (PARTITION BY a ORDER BY {order}, b) AS ord FROM st)"


def _vote_sql(found: str, hints: str, backup: str, keys: str, cap: int = 7) -> str:
    """Votes per candidate, then the backup list, cut to the cap."""
    return f"""votes AS (SELECT {keys}, h.dst AS cand, count(*) AS v FROM {found} f JOIN {hints} h ON f.l = h.src GROUP BY ALL),
open1 AS (SELECT v.* FROM votes v ANTI JOIN {found} f ON {' AND '.join(f'v.{k} = f.{k}' for k in keys.split(', '))} AND v.cand = f.l),
back AS (SELECT DISTINCT {keys}, b.t AS cand, b.o FROM {found}, {backup} b(t, o)),
open2 AS (SELECT b.* FROM back b ANTI JOIN {found} f ON {' AND '.join(f'b.{k} = f.{k}' for k in keys.split(', '))} AND b.cand = f.l
  ANTI JOIN open1 o ON {' AND '.join(f'b.{k} = o.{k}' for k in keys.split(', '))} AND b.cand = o.cand),
allc AS (SELECT {keys}, cand, 0 AS part, -v AS o FROM open1 UNION ALL SELECT {keys}, cand, 1, o FROM open2),
rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY part, o, cand) AS n FROM allc),
cands AS (SELECT {keys}, string_agg(cand, '|' ORDER BY n) AS candidates FROM rk WHERE n <= {cap} GROUP BY ALL)"""


_LV = " WHEN ".join(f"t IN ({', '.join(repr(x) for x in ts)}) THEN '{lv}'" for lv, ts in L.LEVELS.items())
_PARAM, _CLASS = "|".join(L.PARAMETER_LEVEL), "|".join(L.CLASS_LEVEL)
_SYN = "'=== m.py ===' || chr(10) || 'BEFORE:' || chr(10) || before || chr(10) || 'AFTER:' || chr(10) || after || chr(10) || '---'"
_FLAT = "'BEFORE:' || chr(10) || before || chr(10) || '---' || chr(10) || 'AFTER:' || chr(10) || after"
_ING = f"""o AS (SELECT *, {D.URL} AS url, {D.DIFF} AS diff, {D.BEFORE_MAIN} AS before, {D.AFTER_MAIN} AS after FROM orders),
i AS (SELECT *, CASE WHEN o_orderpriority < '2' THEN 'new' WHEN o_orderpriority < '3' THEN 'old' WHEN o_orderpriority < '4' THEN 'flat' ELSE 'commit' END AS fmt FROM o),
k AS (SELECT *, CASE fmt WHEN 'commit' THEN diff WHEN 'flat' THEN {_FLAT} ELSE {_SYN} END AS built FROM i)"""
_CLEANED = "length(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"

ORACLE = {
    "multilabel_micro_prf": f"WITH {_ROWS}, s AS ({_counts('pn', 'gn', 'k', _BY_TRACK)}), {_N} SELECT track, n, tp, fp, fn, {_PRF} FROM s JOIN n USING (track)",
    "exact_case_score": f"""WITH {_ROWS}, f AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.track, b.track) AS track, a.t AS pt, b.t AS gt
FROM pe a FULL JOIN gt b ON a.case_id = b.case_id AND a.track = b.track AND a.t = b.t)
SELECT r.case_id, r.track, count(*) FILTER (pt IS NOT NULL AND gt IS NOT NULL) AS tp, count(*) FILTER (pt IS NOT NULL AND gt IS NULL) AS fp,
count(*) FILTER (pt IS NULL AND gt IS NOT NULL) AS fn, coalesce(string_agg(gt, '|' ORDER BY gt) FILTER (pt IS NULL), '') AS missed,
coalesce(string_agg(pt, '|' ORDER BY pt) FILTER (gt IS NULL), '') AS false_alarms FROM runs r LEFT JOIN f ON r.case_id = f.case_id AND r.track = f.track GROUP BY ALL""",
    "track_scores": _TRACKS,
    "per_type_confusion": f"""WITH {_ROWS}, p1 AS (SELECT * FROM pn), g1 AS (SELECT * FROM gn),
s AS ({_counts('p1', 'g1', 'k', 'coalesce(a.k, b.k) AS type')}), m AS (SELECT count(*) AS n FROM runs)
SELECT type, tp, fp, fn, n - tp - fp - fn AS tn, round({_div('tp', 'tp + fp')}, 4) AS precision, round({_div('tp', 'tp + fn')}, 4) AS recall,
round((n - fp - fn) / n, 4) AS accuracy, round({_div('2.0 * tp', '2 * tp + fp + fn')}, 4) AS f1 FROM s, m""",
    "macro_accuracy": f"""WITH {_ROWS}, p1 AS (SELECT * FROM pn), g1 AS (SELECT * FROM gn),
s AS ({_counts('p1', 'g1', 'k', 'coalesce(a.k, b.k) AS type')}), m AS (SELECT count(*) AS n FROM runs)
SELECT round(avg(round((n - fp - fn) / n, 4)), 6) AS macro_accuracy FROM s, m""",
    "paired_track_delta": f"""WITH {_ROWS}, {_SHARED}, p2 AS (SELECT * FROM px SEMI JOIN common USING (case_id)), g2 AS (SELECT * FROM gx SEMI JOIN common USING (case_id)),
s AS ({_counts('p2', 'g2', 't', _BY_TRACK)}), q AS (SELECT track, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r, {_div('2.0 * tp', '2 * tp + fp + fn')} AS f1 FROM s)
SELECT x.track, round(x.p - b.p, 9) AS d_p, round(x.r - b.r, 9) AS d_r, round(x.f1 - b.f1, 9) AS d_f1 FROM q x, q b WHERE b.track = 'base' AND x.track <> 'base'""",
    "best_track": f"""WITH s AS ({_TRACKS}) SELECT 'f1' AS metric, (SELECT track FROM s ORDER BY f1 DESC, track LIMIT 1) AS track
UNION ALL SELECT 'p', (SELECT track FROM s ORDER BY p DESC, track LIMIT 1) UNION ALL SELECT 'r', (SELECT track FROM s ORDER BY r DESC, track LIMIT 1)""",
    "type_report": f"""WITH {_ROWS}, s AS ({_counts('px', 'gx', 't', 'coalesce(a.track, b.track) AS track, coalesce(a.t, b.t) AS type')}),
g AS (SELECT track, t AS type FROM (SELECT DISTINCT track FROM runs), (VALUES {', '.join(f"('{t}')" for t in L.KNOWN_TYPES)}) v(t)),
z AS (SELECT g.track, g.type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM g LEFT JOIN s ON g.track = s.track AND g.type = s.type)
SELECT track, type, tp, fp, fn, round({_div('tp', 'tp + fp')}, 4) AS precision, round({_div('tp', 'tp + fn')}, 4) AS recall, round({_div('2.0 * tp', '2 * tp + fp + fn')}, 4) AS f1 FROM z""",
    "undefined_labels": f"WITH {D.DUCK_RUNS}, p AS (SELECT unnest(predicted) AS type FROM runs) SELECT type, count(*) AS n FROM p WHERE {_NORM.format('type')} NOT IN ({_KNOWN}) GROUP BY type",
    "event_tracks": """WITH c AS (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))
SELECT event_type AS track, count(*) AS n, count(*) FILTER (value > 10) AS n_high FROM events SEMI JOIN c USING (user_id) GROUP BY 1""",
    "label_history": f"WITH {_ROWS}, {_HIST} SELECT type, support, round(p, 9) AS precision FROM hist",
    "confidence_hard_block": f"""WITH {_ROWS}, {_HIST}, {_DET} SELECT case_id, d.track, d.type, confidence, CASE WHEN h.p < 0.30 THEN 'hard_block_low_P' WHEN confidence < 80 THEN 'confidence<threshold' END AS reason
FROM det2 d LEFT JOIN hist h ON d.type = h.type AND support >= 3""",
    "candidate_floor": f"WITH {_ROWS}, {_HIST}, {_DET} SELECT case_id, d.track, d.type, CASE WHEN h.p < 0.5 THEN 'historical_P<floor' END AS reason FROM det2 d LEFT JOIN hist h ON d.type = h.type AND support >= 3",
    "cooccurrence_npmi": f"WITH {_BASK}, {_STATS} SELECT a, b, n_ab, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(npmi, 6) AS npmi FROM st",
    "mined_hints": f"""WITH {_BASK}, {_STATS}, {_hints_cte('n_ab DESC', 'h1')}, {_hints_cte('round(npmi, 9) DESC', 'h2')}, {_hints_cte('round(lift * confidence, 9) DESC', 'h3')}
SELECT 'count' AS version, src, ord, dst FROM h1 WHERE ord <= 4 UNION ALL SELECT 'npmi', src, ord, dst FROM h2 WHERE ord <= 4 UNION ALL SELECT 'rule', src, ord, dst FROM h3 WHERE ord <= 4""",
    "association_rules": f"WITH {_BASK}, {_STATS}, {_RULES} SELECT antecedent, consequent, n_xc, round(confidence, 10) AS confidence, round(lift, 10) AS lift, round(score, 10) AS score FROM rules",
    "rule_strength_max": f"{_RULE_BASE} SELECT labels, target, round(strength, 6) AS strength FROM str",
    "scored_candidates": f"""{_RULE_BASE}, g AS (SELECT labels, s.l AS target, s.k / n.n AS prior FROM sets, s, n WHERE NOT list_contains(string_split(labels, '|'), s.l)),
z AS (SELECT g.labels, g.target, round(1.0 * coalesce(strength, 0) + 0.5 * 0.1 + 0.25 * prior, 9) AS score FROM g LEFT JOIN str ON g.labels = str.labels AND g.target = str.target)
SELECT labels, target, rank FROM (SELECT *, row_number() OVER (PARTITION BY labels ORDER BY score DESC, target DESC) AS rank FROM z WHERE score > 0) WHERE rank <= 5""",
    "vote_candidates": f"""WITH {_BASK}, {_STATS}, {_hints_cte('n_ab DESC', 'h0')}, hints AS (SELECT * FROM h0 WHERE ord <= 4), found AS (SELECT c AS case_id, l FROM bask),
{_vote_sql('found', 'hints', "(VALUES ('Brand#1', 0), ('Brand#2', 1))", 'case_id')} SELECT DISTINCT f.case_id, coalesce(candidates, '') AS candidates FROM found f LEFT JOIN cands USING (case_id)""",
    "missing_candidates": f"""WITH {_ROWS}, hints(src, dst) AS (VALUES {_HINT_ROWS}), found AS (SELECT case_id, track, t AS l FROM pr WHERE {_NORM.format('t')} IN ({_KNOWN})),
{_vote_sql('found', 'hints', f'(VALUES {_BACKUP_ROWS})', 'case_id, track')}
SELECT r.case_id, r.track, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.case_id = r.case_id AND f.track = r.track) THEN coalesce(candidates, '')
WHEN r.track = 'base' THEN '{_PARAM}' ELSE '{_CLASS}' END AS candidates FROM runs r LEFT JOIN cands c ON r.case_id = c.case_id AND r.track = c.track""",
    "confusion_targets": f"""WITH {D.DUCK_RUNS}, p AS (SELECT case_id, track, unnest(predicted) AS t FROM runs), c AS (
SELECT case_id, track, t FROM p WHERE t IN ({', '.join(repr(x) for x in L.CONFUSABLE)}) UNION
SELECT case_id, track, x.v FROM p, (VALUES {', '.join(f"('{x}')" for x in L.COMPOUNDS)}) x(v) WHERE t IN ({', '.join(repr(x) for x in L.COMPOUND_TRIGGERS)})),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id, track ORDER BY t) AS n FROM c)
SELECT r.case_id, r.track, coalesce(string_agg(t, '|' ORDER BY t), '') AS targets FROM runs r LEFT JOIN k ON r.case_id = k.case_id AND r.track = k.track AND n <= 6 GROUP BY ALL""",
    "level_rollup": f"WITH {D.DUCK_RUNS}, p AS (SELECT track, unnest(predicted) AS t FROM runs) SELECT track, CASE WHEN {_LV} ELSE 'none' END AS level, count(*) AS n FROM p GROUP BY ALL",
    "definition_lookup": """WITH b AS (SELECT p_type AS k, CAST(max(p_size) AS VARCHAR) AS text FROM part GROUP BY 1), p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN lower(p_type) ELSE p_type END AS name FROM part)
SELECT p_partkey, name, k AS found_key, text FROM p JOIN b ON lower(name) = lower(k)""",
    "ingest_layouts": f"""WITH {_ING} SELECT o_orderkey, fmt, CASE WHEN fmt = 'flat' THEN md5(built) ELSE right(translate(url, '/:', '__'), 180) END AS case_id,
CASE WHEN fmt = 'flat' THEN '' ELSE url END AS url, CASE WHEN fmt = 'commit' THEN 'Move Class|Add Parameter' ELSE 'Move Class' END AS types, md5(built) AS diff_md5,
CASE WHEN fmt = 'commit' THEN 0 ELSE 1 END AS n_before, CASE fmt WHEN 'new' THEN 'x:0.9|y:0.4' WHEN 'commit' THEN '' ELSE 'x:0.5' END AS exemplars FROM k""",
    "clean_totals": f"""WITH {_ING}, c AS (SELECT fmt, CASE WHEN fmt = 'commit' THEN 0 ELSE length(before) + length(after) END + CASE fmt WHEN 'new' THEN 34 WHEN 'commit' THEN 0 ELSE 17 END AS x,
CASE WHEN fmt = 'commit' THEN 0 ELSE {_CLEANED.format('before')} + {_CLEANED.format('after')} END + CASE fmt WHEN 'new' THEN 24 WHEN 'commit' THEN 0 ELSE 12 END AS y FROM k)
SELECT fmt, count(*) AS n, CAST(sum(x) AS BIGINT) AS chars_before, CAST(sum(y) AS BIGINT) AS chars_after FROM c GROUP BY fmt""",
    "case_records": f"""WITH {D.DUCK_RUNS}, r AS (SELECT track || '/' || case_id AS case_id, predicted, truth FROM runs), s AS (SELECT case_id, list_filter(predicted, lambda t: NOT starts_with(t, 'UnknownType')) AS fk,
list_filter(predicted, lambda t: starts_with(t, 'UnknownType')) AS fu, truth FROM r)
SELECT case_id, array_to_string(fk, '|') AS final_known, array_to_string(fu, '|') AS final_undefined, len(list_intersect(fk, truth)) AS tp,
len(list_filter(fk, lambda t: NOT list_contains(truth, t))) AS fp, len(list_filter(truth, lambda t: NOT list_contains(fk, t))) AS fn FROM s""",
}
