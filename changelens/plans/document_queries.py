"""Filters, texts, sets and samples over the document, page, event and order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from changelens.functions import text as X
from changelens.functions.diffs import context_window
from changelens.operators import context as C
from changelens.operators import filters, sampling, setops
from changelens.plans.derived import table


def _docs(spark, d, *cols):
    return table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), *cols)


def type_filter(spark, d):
    docs = _docs(spark, d, F.array(F.upper("lang"), "source").alias("types"))
    return filters.by_types(docs, [" EN", "Src3 "], "types").select("case_id")


def token_budget_filter(spark, d):
    docs = _docs(spark, d, F.col("text").alias("commit_diff"))
    return filters.within_token_budget(docs, 2000, exemplars=None).select("case_id")


def type_avg_size_filter(spark, d):
    docs = _docs(spark, d, F.col("text").alias("commit_diff"), F.array("lang", "source").alias("refactoring_types"))
    return filters.within_type_size(docs, 2.0).select("case_id")


def _cited_turns(spark, d):
    """Each turn cites from the turn before it."""
    t = table(spark, d, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("evidence"), "context")


def citation_overlap(spark, d):
    out = filters.citation(_cited_turns(spark, d), "evidence", "context", 0.30)
    return out.select("conv_id", "turn", F.round("overlap", 6).alias("overlap"), F.array_join("missing_tokens", ",").alias("missing"), "keep")


def unknown_overlap(spark, d):
    out = filters.unknown_citation(_cited_turns(spark, d), "evidence", "context", 0.40)
    return out.select("conv_id", "turn", "keep")


def best_line_window(spark, d):
    """The third sentence of every document, looked up in the document itself."""
    docs = _docs(spark, d, "text", F.split_part("text", F.lit("."), F.lit(3)).alias("evidence"))
    return docs.select("case_id", F.md5(context_window("evidence", "text")).alias("window_md5"))


def _keyed_texts(spark, d, name, id_col, *more):
    """Texts by digest of their trimmed, lower-case form: only ids and digests are exchanged."""
    key = F.when(~X.blank("text"), F.md5(F.lower(X.strip("text")))).otherwise("")
    return table(spark, d, name).select(F.lit(0).alias("g"), F.col(id_col).alias("id"), key.alias("name"), *more)


def ordered_dedupe(spark, d):
    rows = _keyed_texts(spark, d, "documents", "doc_id", "source")
    return setops.ordered_dedupe(rows, ["g"], "name", "id").select(F.col("id").alias("doc_id"), "source")


def union_minus(spark, d):
    """Benchmark texts, then documents whose text is not among them."""
    digest = F.md5("text").alias("text_md5")
    b = _keyed_texts(spark, d, "benchmark", "item_id", digest)
    t = _keyed_texts(spark, d, "documents", "doc_id", digest)
    return setops.append_new(b, t, ["g"], "name", "id").select("id", "text_md5")


def mutex_collapse(spark, d):
    t = _event_types(spark, d)
    return t.select("user_id", F.array_join(F.array_sort(setops.collapse_compounds("types")), ",").alias("types"))


_AS_LABEL = {"click": "Move Method", "view": "Rename Method", "purchase": "Move And Rename Method",
             "signup": "Extract Method", "error": "Extract And Move Method"}


def _event_types(spark, d):
    """Labels per user and day: a set over the five event types."""
    book = F.create_map(*[F.lit(x) for p in _AS_LABEL.items() for x in p])
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.element_at(book, F.col("event_type")).alias("t"))
    return e.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("t")).alias("types"))


def merged_labels(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.array(F.array("o_orderpriority", F.lower("o_orderpriority")),
                              F.array(F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.col("o_orderstatus"))).alias("ls"))
    return o.select("o_orderkey", F.array_join(setops.merge_types("ls"), "|").alias("merged"))


def consensus_vote(spark, d):
    """Three days are three calls: an event type needs every day of the user, or half of them."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("case_id"), (F.dayofmonth("ts") % 3).alias("call"), F.col("event_id").alias("ord"),
        F.upper("event_type").alias("type"), F.col("props").alias("evidence"))
    votes = e.select("*", F.explode(F.array(F.lit("defined"), F.lit("undefined"))).alias("kind"))
    # one vote per call and name, as each call is already free of duplicates
    once = setops.ordered_dedupe(votes, ["case_id", "call", "kind"], "type", "ord")
    calls = e.select("case_id").distinct().withColumn("n_calls", F.lit(3))
    return setops.consensus(once, calls).select("case_id", "kind", "type", "evidence", "n_agree", "n_votes")


def group_split(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return sampling.group_split(pages, "host").select("page_id", "host", "part")


def type_sample(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("case_id"), F.explode(F.array("lang", "source")).alias("type"))
    return sampling.sample_per_type(rows, 5).select("case_id", "pos")


def round_robin_quota(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("type"))
    out = sampling.interleave(rows, 30)
    return out.select("case_id", "type", F.col("round").cast("bigint").alias("round"))


def round_robin_schedule(spark, d):
    """Documents with two labels each; labelled documents count as done."""
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("case_id"), F.explode(F.array("lang", "source")).alias("type"))
    done = table(spark, d, "labels").select(F.col("doc_id").alias("case_id"))
    return sampling.round_robin(rows, 4, done)


def resume_anti_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("type"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"))
    return sampling.unfinished(orders, done).select("case_id", "type")


def open_quota(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("type"), "o_orderstatus")
    finished = orders.where("o_orderstatus = 'F'")
    n = 1500
    return sampling.remaining_quota(orders, finished, n).select("type", "quota")


def chat_transcript(spark, d):
    out = C.transcript(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return out.select("conv_id", "page", "n_turns", F.md5("transcript").alias("text_md5"))


def case_keys(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "pages").select("page_id", X.case_key(none, "url", "html").alias("key"),
                                           X.case_key(none, none, "html").alias("digest_key"))


def greedy_char_budget(spark, d):
    """Turns of every conversation, taken in order while they fit 1,000 characters."""
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.length("text").cast("bigint").alias("n")).alias("x"))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("items"))
    kept = lists.select("conv_id", F.explode(C.fit_budget("items", lambda x: x["n"], 1000)).alias("x"))
    return kept.select("conv_id", "x.turn", F.col("x.n").alias("n_chars"))


def rank_with_fallback(spark, d):
    """Orders of each customer, best score first; a missing rerank score falls back to the price."""
    o = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 2).alias("rerank_score"),
        F.col("o_totalprice").alias("similarity"))
    return C.best_first(o, ["o_custkey"], 3, "o_orderkey").select("o_custkey", "o_orderkey", "rank")


def context_budget(spark, d):
    """Characters left for exemplars next to every document, for two shares of the window."""
    return table(spark, d, "documents").select(
        "doc_id", C.char_budget(8192, "text", 0.65).alias("detect_budget"), C.char_budget(8192, "text", 0.5).alias("verify_budget"))


QUERIES = {f.__name__: f for f in (
    type_filter, token_budget_filter, type_avg_size_filter, citation_overlap, unknown_overlap, best_line_window, ordered_dedupe,
    union_minus, mutex_collapse, merged_labels, consensus_vote, group_split, type_sample, round_robin_quota, round_robin_schedule,
    resume_anti_join, open_quota, chat_transcript, case_keys, greedy_char_budget, rank_with_fallback, context_budget)}

_TURNS = "c AS (SELECT a.conv_id, a.turn, a.text AS evidence, b.text AS context FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"
_TOK = r"list_distinct(list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '{p}')))"


def _tok(c, p):
    return _TOK.format(c=c, p=p)


_ID3, _ID1 = "[A-Za-z_][A-Za-z0-9_]{2,}", "[A-Za-z_][A-Za-z0-9_]*"
_MD5 = "md5('42|' || {})"
_PARTS = ", ".join(f"('{k}', '{v}')" for k, v in _AS_LABEL.items())

ORACLE = {
    "type_filter": "SELECT doc_id AS case_id FROM documents WHERE lower(lang) = 'en' OR source = 'src3'",
    "token_budget_filter": "SELECT doc_id AS case_id FROM documents WHERE length(text) // 4 < 1400",
    "type_avg_size_filter": """WITH a AS (SELECT lang, avg(length(text)) * 2 AS m FROM documents GROUP BY lang),
b AS (SELECT source, avg(length(text)) * 2 AS m FROM documents GROUP BY source)
SELECT doc_id AS case_id FROM documents JOIN a USING (lang) JOIN b USING (source) WHERE length(text) <= a.m AND length(text) <= b.m""",
    "citation_overlap": f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, {_tok('evidence', _ID3)} AS e, {_tok('context', _ID3)} AS x FROM c)
SELECT conv_id, turn, CASE WHEN len(e) > 0 THEN round(len(list_intersect(e, x)) / len(e), 6) END AS overlap,
array_to_string(list_sort(list_filter(e, lambda v: NOT list_contains(x, v))), ',') AS missing,
CASE WHEN len(e) > 0 THEN len(list_intersect(e, x)) / len(e) >= 0.30 ELSE true END AS keep FROM t""",
    "unknown_overlap": f"""WITH {_TURNS}, t AS (SELECT conv_id, turn, {_tok('evidence', _ID1)} AS e, {_tok('context', _ID1)} AS x FROM c)
SELECT conv_id, turn, CASE WHEN len(e) > 0 THEN len(list_intersect(e, x)) / len(e) >= 0.40 ELSE false END AS keep FROM t""",
    "best_line_window": r"""WITH d AS (SELECT doc_id, text, list_distinct(regexp_extract_all(split_part(text, '.', 3), '[\p{L}\p{N}_]{3,}')) AS want,
string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, want, unnest(ls) AS ln, generate_subscripts(ls, 1) AS pos FROM d),
s AS (SELECT doc_id, pos, len(list_intersect(want, regexp_extract_all(ln, '[\p{L}\p{N}_]{3,}'))) AS hit FROM l),
b AS (SELECT doc_id, max(hit) AS best, arg_min(pos, -hit * 1000000 + pos) AS hit_at FROM s GROUP BY doc_id)
SELECT d.doc_id AS case_id, md5(CASE WHEN len(want) > 0 AND best > 0 AND best / len(want) >= 0.4
THEN array_to_string(ls[greatest(1, hit_at - 5):hit_at + 5], chr(10)) ELSE text END) AS window_md5 FROM d JOIN b USING (doc_id)""",
    "ordered_dedupe": r"""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) ORDER BY doc_id) AS n
FROM documents WHERE regexp_matches(text, '\S')) WHERE n = 1""",
    "union_minus": r"""WITH a AS (SELECT 0 AS s, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents)
SELECT id, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) ORDER BY s, id) AS n
FROM a WHERE regexp_matches(text, '\S')) WHERE n = 1""",
    "mutex_collapse": f"""WITH m(e, t) AS (VALUES {_PARTS}), s AS (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT t) AS ts FROM events JOIN m ON e = event_type GROUP BY ALL)
SELECT user_id, array_to_string(list_sort(list_filter(ts, lambda x: NOT (list_contains(ts, 'Move And Rename Method') AND x IN ('Move Method', 'Rename Method'))
AND NOT (list_contains(ts, 'Extract And Move Method') AND x IN ('Extract Method', 'Move Method')))), ',') AS types FROM s""",
    "merged_labels": "SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus AS merged FROM orders",
    "consensus_vote": """WITH e AS (SELECT user_id AS case_id, day(ts) % 3 AS call, event_id AS ord, upper(event_type) AS type, props AS evidence FROM events),
v AS (SELECT case_id, type, call, min(ord) AS ord, arg_min(evidence, ord) AS evidence FROM e GROUP BY ALL),
g AS (SELECT case_id, type, count(DISTINCT call) AS n_agree, count(*) AS n_votes, arg_min(evidence, call * 1000000000 + ord) AS evidence FROM v GROUP BY ALL)
SELECT case_id, 'defined' AS kind, type, evidence, n_agree, n_votes FROM g WHERE n_agree = 3
UNION ALL SELECT case_id, 'undefined', type, evidence, n_agree, n_votes FROM g WHERE n_votes >= 2""",
    "group_split": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
h AS (SELECT host, row_number() OVER (ORDER BY {_MD5.format('host')}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT host FROM p))
SELECT page_id, host, CASE WHEN r <= greatest(1, floor(n * (1.0 - 0.2))) THEN 'train' ELSE 'val' END AS part FROM p JOIN h USING (host)""",
    "type_sample": f"""WITH r AS (SELECT doc_id, lang AS type FROM documents UNION SELECT doc_id, source FROM documents),
k AS (SELECT DISTINCT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {_MD5.format("type || '|' || doc_id")}) AS n FROM r) WHERE n <= 5)
SELECT doc_id AS case_id, row_number() OVER (ORDER BY {_MD5.format('doc_id')}) AS pos FROM k""",
    "round_robin_quota": f"""SELECT * FROM (SELECT doc_id AS case_id, lang AS type,
row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format("lang || '|' || doc_id")}) AS round FROM documents) WHERE round <= 30""",
    "round_robin_schedule": """WITH RECURSIVE r AS (SELECT DISTINCT doc_id AS k, t AS type FROM (SELECT doc_id, lang AS t FROM documents UNION ALL SELECT doc_id, source FROM documents)
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
ls AS (SELECT type, list(k ORDER BY md5('42|' || type || '|' || k), k) AS ks, row_number() OVER (ORDER BY type) - 1 AS ti FROM r GROUP BY type),
n AS (SELECT count(*) AS n FROM ls),
f(s, taken, pick, type) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
UNION ALL SELECT s + 1, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, p, ty FROM (
  SELECT f.s, f.taken, ls.type AS ty, [k FOR k IN ls.ks IF NOT list_contains(f.taken, k)][1] AS p
  FROM f, n, ls WHERE ls.ti = (f.s + 1) % n.n AND f.s + 1 < 4 * n.n))
SELECT row_number() OVER (ORDER BY s) - 1 AS round_robin_index, type, pick AS case_id FROM f WHERE pick IS NOT NULL""",
    "resume_anti_join": """SELECT o_orderkey AS case_id, o_orderpriority AS type FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "open_quota": """SELECT o_orderpriority AS type, greatest(0, 1500 - count(*) FILTER (o_orderstatus = 'F')) AS quota FROM orders GROUP BY 1""",
    "chat_transcript": """SELECT conv_id, CAST(0 AS BIGINT) AS page, count(*) AS n_turns,
md5(string_agg('--- ' || role || ' ---' || chr(10) || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1, 2""",
    "case_keys": "SELECT page_id, CASE WHEN length(url) <= 180 THEN translate(url, '/:', '__') ELSE md5(url) || '_' || right(translate(url, '/:', '__'), 147) END AS key, md5(html) AS digest_key FROM pages",
    "greedy_char_budget": """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, rn, turn, n, n <= 1000 AS ok, CASE WHEN n <= 1000 THEN n ELSE 0 END AS used FROM r WHERE rn = 1
UNION ALL SELECT r.conv_id, r.rn, r.turn, r.n, f.used + r.n <= 1000, CASE WHEN f.used + r.n <= 1000 THEN f.used + r.n ELSE f.used END
FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
SELECT conv_id, turn, n AS n_chars FROM f WHERE ok""",
    "rank_with_fallback": """SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
    "context_budget": """SELECT doc_id, greatest(0, CAST(floor(8192 * 4 * 0.65) AS BIGINT) - length(text) - 12000) AS detect_budget,
greatest(0, CAST(floor(8192 * 4 * 0.5) AS BIGINT) - length(text) - 12000) AS verify_budget FROM documents""",
}
