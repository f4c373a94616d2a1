"""Retrieval queries over the embedding table.

Every label's mean-pooled query meets every exemplar of the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from changelens.operators import retrieval as R
from changelens.plans.derived import table

DIM = 64
CHANNELS = {"c0": (1, 32), "c1": (33, 24), "c2": (57, 8)}


def _index(spark, d):
    return R.exemplar_index(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


def _queries(spark, d):
    return R.label_queries(_index(spark, d), DIM)


def _others(queries):
    """Each query asks for every label but its own."""
    labels = queries.agg(F.collect_set("query_id").alias("ls"))  # the label dictionary
    return queries.withColumn("ls", labels.scalar()).select(
        "query_id", "vec", F.array_except("ls", F.array("query_id")).alias("targets"))


def exemplar_topk_by_label(spark, d):
    out = R.retrieve_for_types(_queries(spark, d), _index(spark, d), k=5, use_mmr=False)
    return out.select("query_id", "label", "row_id", "rank")


def mmr_diverse(spark, d):
    out = R.retrieve_for_types(_queries(spark, d), _index(spark, d), k=5, top_n=20)
    return out.select("query_id", "label", "row_id", "rank")


def typed_union_topk(spark, d):
    out = R.retrieve_pooled(_others(_queries(spark, d)), _index(spark, d), k=15)
    return out.select("query_id", "label", "row_id", "rank")


def three_channel_fusion(spark, d):
    q = _others(_queries(spark, d))
    for name, (start, n) in CHANNELS.items():
        q = q.withColumn(name, F.slice("vec", start, n))
    out = R.retrieve_pooled(R.fuse_queries(q, list(CHANNELS)), _index(spark, d), k=15)
    return out.select("query_id", "label", "row_id", "rank")


def pooled_budget_bucket(spark, d):
    return R.pooled_budget(_others(_queries(spark, d)), _index(spark, d), k=5).select(
        "query_id", "label", "row_id", "rank", "bucket_rank")


def mean_pool_query(spark, d):
    q = _queries(spark, d)
    return q.select("query_id", F.posexplode("vec").alias("pos", "x")).select(
        "query_id", "pos", F.round("x", 6).alias("x"))


def min_sim_neighbors(spark, d):
    out = R.nearest_trophies(_others(_queries(spark, d)), _index(spark, d), k=3, min_sim=0.1)
    return out.select("query_id", "label", "row_id", "rank", F.round("sim", 3).alias("sim"))


def first_without_query(spark, d):
    ix = _index(spark, d)
    return R.without_query(ix.select("label").distinct(), ix, k=5).select("label", "row_id", "rank")


def query_vector_lookup(spark, d):
    """Pages and benchmark items look their vector up, in the embedding table first and a table of the items second."""
    item = F.concat(F.lit("item-"), F.col("item_id").cast("string"))
    keys = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url")).union(table(spark, d, "benchmark").select(item))
    main = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("url"), F.col("embedding").alias("vec"))
    bench = table(spark, d, "benchmark").select(item.alias("url"), F.array(F.lit(0.0).cast("float")).alias("vec"))
    return R.lookup_queries(keys, main, bench).select("url", "source", F.size("vec").alias("dim"))


def anchored_retrieval(spark, d):
    """Each document source asks with the mean of its documents' vectors."""
    anchors = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("id"))
    queries = R.mean_pool_queries(_index(spark, d), anchors, DIM)
    return R.retrieve_pooled(queries, _index(spark, d), k=5).select("query_id", "label", "row_id", "rank")


def hydrated_exemplars(spark, d):
    """Ranked ids with their document record; ids without one stay."""
    top = R.retrieve_for_types(_queries(spark, d), _index(spark, d), k=5, use_mmr=False)
    pool = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "n_chars")
    ranked = top.select("query_id", "label", "rank", F.col("row_id").cast("string").alias("id"))
    return R.hydrate(ranked, pool, "left").select("query_id", "label", "rank", "id", "lang", "n_chars")


_BASE = """WITH raw AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT row_id, label, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-8)) AS v FROM raw),
parts AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY label, pos),
cent AS (SELECT label AS query_id, list(x ORDER BY pos) AS m FROM means GROUP BY label),
q AS (SELECT query_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM cent),
s AS (SELECT q.query_id, u.label, u.row_id, round(list_dot_product(q.v, u.v), 9) AS sim FROM q CROSS JOIN u)"""
_POOL = _BASE + """,
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS rank FROM s WHERE label <> query_id)"""


def _mmr_sql(k: int, n: int) -> str:
    steps = [f"""c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, row_id) AS ord FROM s),
top AS (SELECT c.*, u.v FROM c JOIN u USING (row_id, label) WHERE ord <= {n}),
s1 AS (SELECT query_id, label, row_id, v, 1 AS rank FROM top WHERE ord = 1),
p1 AS (SELECT t.*, round(list_dot_product(t.v, x.v), 9) AS pen FROM top t JOIN s1 x USING (query_id, label) WHERE t.row_id <> x.row_id)"""]
    for i in range(2, k + 1):
        steps.append(f"""r{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id, label
      ORDER BY round(0.5 * sim - 0.5 * pen, 9) DESC, ord) AS best FROM p{i - 1}),
s{i} AS (SELECT query_id, label, row_id, v, {i} AS rank FROM r{i} WHERE best = 1),
p{i} AS (SELECT t.query_id, t.label, t.row_id, t.sim, t.ord, t.v, greatest(t.pen, round(list_dot_product(t.v, x.v), 9)) AS pen
      FROM p{i - 1} t JOIN s{i} x USING (query_id, label) WHERE t.row_id <> x.row_id)""")
    union = " UNION ALL ".join(f"SELECT query_id, label, row_id, rank FROM s{i}" for i in range(1, k + 1))
    return _BASE + ",\n" + ",\n".join(steps) + "\n" + union


QUERIES = {f.__name__: f for f in (
    exemplar_topk_by_label, mmr_diverse, typed_union_topk, three_channel_fusion, pooled_budget_bucket,
    mean_pool_query, min_sim_neighbors, first_without_query, query_vector_lookup, anchored_retrieval, hydrated_exemplars)}

_TOP5 = """SELECT query_id, label, row_id, rank FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, row_id) AS rank FROM s) WHERE rank <= 5"""

ORACLE = {
    "exemplar_topk_by_label": f"{_BASE} {_TOP5}",
    "mmr_diverse": _mmr_sql(5, 20),
    "typed_union_topk": f"{_POOL} SELECT query_id, label, row_id, rank FROM p WHERE rank <= 15",
    "three_channel_fusion": _BASE.replace(
        "round(list_dot_product(q.v, u.v), 9)",
        "round(0.345 * list_dot_product(q.v[1:32], u.v[1:32]) + 0.609 * list_dot_product(q.v[33:56], u.v[33:56]) "
        "+ 0.046 * list_dot_product(q.v[57:64], u.v[57:64]), 9)") + """
SELECT query_id, label, row_id, rank FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS rank FROM s WHERE label <> query_id) WHERE rank <= 15""",
    "pooled_budget_bucket": f"""{_POOL}, n AS (SELECT count(DISTINCT label) - 1 AS n FROM u)
SELECT * FROM (SELECT query_id, label, row_id, rank, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS bucket_rank
FROM p, n WHERE rank <= least(5 * n.n, 100)) WHERE bucket_rank <= 5""",
    "mean_pool_query": f"{_BASE} SELECT query_id, unnest(range(len(v))) AS pos, round(unnest(v), 6) AS x FROM q",
    "min_sim_neighbors": f"{_POOL} SELECT query_id, label, row_id, rank, round(sim, 3) AS sim FROM p WHERE rank <= 3 AND sim >= 0.1",
    "first_without_query": """SELECT * FROM (SELECT CAST(label AS VARCHAR) AS label, vec_id AS row_id,
row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) WHERE rank <= 5""",
    "query_vector_lookup": """SELECT CAST(page_id AS VARCHAR) AS url, 'main' AS source, len(embedding) AS dim FROM pages JOIN embeddings ON page_id = vec_id
UNION ALL SELECT 'item-' || item_id, 'bench', 1 FROM benchmark""",
    "anchored_retrieval": _BASE.replace(
        "parts AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u)",
        "parts AS (SELECT source AS label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u JOIN documents ON doc_id = row_id)") + """
SELECT query_id, label, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS rank FROM s) WHERE rank <= 5""",
    "hydrated_exemplars": f"""{_BASE}, t AS ({_TOP5})
SELECT query_id, label, rank, CAST(row_id AS VARCHAR) AS id, lang, n_chars FROM t LEFT JOIN documents ON row_id = doc_id""",
}
