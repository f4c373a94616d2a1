"""Exemplar retrieval: typed top-k, fusion, pooled budgets, diversification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens import labels as L
from changelens.functions import vectors as V
from changelens.functions.rows import pos_rows
from changelens.plans.session import stored

CHUNK_ROWS = 32768  # rows of a label that are divided into blocks together
BLOCK_ROWS = 512  # rows that a block holds on average
BLOCK_QUERIES = 1024  # queries and
META_BLOCKS = 8192  # blocks whose bounds one task works out together
FIRST = 2  # blocks that are scored for a floor
ASKED_PARTS = 16  # parts of the queries that ask for one block


def exemplar_index(table: DataFrame, row_id: str, label: str, embedding: str) -> DataFrame:
    """Bring a table into the index layout ``(row_id, id, label, embedding)``."""
    return table.select(
        F.col(row_id).cast("bigint").alias("row_id"), F.col(row_id).cast("string").alias("id"),
        F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))


def checked_index(embeddings: DataFrame, meta: DataFrame) -> DataFrame:
    """Join vectors to their ids and labels by row; a row without a partner is an error."""
    both = embeddings.join(meta, "row_id", "full_outer")
    whole = F.assert_true(
        F.col("id").isNotNull() & F.col("embedding").isNotNull(), F.lit("meta rows != embedding rows"))
    return both.where(whole.isNull()).select("row_id", "id", "label", "embedding")


def mean_pool_queries(index: DataFrame, anchors: DataFrame, dim: int) -> DataFrame:
    """One unit query per ``query_id`` from the mean of its known anchors.

    ``anchors`` is ``(query_id, id)``. Queries without a known anchor or with a
    vanishing mean are absent from the result.
    """
    rows = anchors.join(index, "id").select("query_id", V.unit("embedding").alias("u"))
    return _unit_means(rows, dim)


def label_queries(index: DataFrame, dim: int) -> DataFrame:
    """The mean-pooled query of every label: all exemplars of the label are its anchors."""
    return _unit_means(index.select(F.col("label").alias("query_id"), V.unit("embedding").alias("u")), dim)


def _unit_means(rows: DataFrame, dim: int) -> DataFrame:
    means = rows.groupBy("query_id").agg(V.mean_vector("u", dim).alias("m"))
    return means.where(F.sqrt(V.dot("m", "m")) >= V.EPS).select("query_id", V.unit("m").alias("vec"))


def lookup_queries(keys: DataFrame, main: DataFrame, bench: DataFrame) -> DataFrame:
    """Query vector by url: the main table first, then the bench table, else no row."""
    m = main.select("url", F.col("vec").alias("main_vec"))
    b = bench.select("url", F.col("vec").alias("bench_vec"))
    found = keys.join(m, "url", "left").join(b, "url", "left")
    return found.withColumn("vec", F.coalesce("main_vec", "bench_vec")).where("vec is not null").select(
        *keys.columns, "vec", F.when(F.col("main_vec").isNotNull(), "main").otherwise("bench").alias("source"))


def fuse_queries(queries: DataFrame, channels: list[str], weights=L.FUSION_WEIGHTS) -> DataFrame:
    """Fold channel weights into the query.

    A weighted sum of dot products is one dot product with the concatenated,
    scaled query, so fusion needs no scoring path of its own.
    """
    parts = [V.scale(c, w) for c, w in zip(channels, weights, strict=True)]
    return queries.withColumn("vec", F.concat(*parts))


def index_blocks(index: DataFrame, normalize: bool = True) -> DataFrame:
    """The index as a stored table of blocks: ``(block, label, n, centre, radius, rows, mat)``.

    Rows of a label are dealt into chunks of about ``CHUNK_ROWS`` by a hash; a chunk is divided by its
    nearest local pivots into balls of similar vectors. ``radius`` bounds the distance of a row to the
    centre. ``mat`` holds the vectors (unit length if ``normalize``) as doubles, row by row. Build it once
    and hand it to ``top_k`` to search the same index again.
    """
    sizes = index.groupBy(F.col("label").alias("of")).agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
    chunk = F.pmod(F.xxhash64("row_id"), F.col("chunks"))
    dealt = index.join(sizes, F.col("label").eqNullSafe(F.col("of"))).select("row_id", "label", "embedding", chunk.alias("chunk"))

    def balls(rows: pd.DataFrame) -> pd.DataFrame:
        return V.balls(rows["row_id"].to_numpy(), rows["label"].iloc[0], np.stack(rows["embedding"]).astype(np.float64), int(rows["chunk"].iloc[0]), BLOCK_ROWS, normalize)

    return stored(dealt.groupBy("label", "chunk").applyInPandas(balls, V.BLOCK))


def block_bounds(queries: DataFrame, blocks: DataFrame, floors: DataFrame | None, first: int, per_label: bool) -> DataFrame:
    """``(query_id, block, bound)``: what a block can score at best, by its centre and radius.

    Without ``floors`` the ``first`` best blocks of each query (and label) are returned; with them, those that
    can reach the query's floor. Only centres meet queries here: groups of queries with groups of blocks.
    """
    counts = queries.agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("n")), blocks.agg(F.ceil(F.count("*") / META_BLOCKS).alias("n"))
    n_q, n_b = (F.greatest(c.scalar(), F.lit(1)).cast("int") for c in counts)
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.withColumn("n_q", n_q).withColumn("n_b", n_b).select("query_id", "vec", "targets", part("query_id", F.col("n_q")).alias("qb"), every(F.col("n_b")).alias("bb"))
    right = blocks.select("block", "label", "centre", "radius").withColumn("n_q", n_q).withColumn("n_b", n_b).select(
        "block", "label", "centre", "radius", part("block", F.col("n_b")).alias("bb"), every(F.col("n_q")).alias("qb"))
    keys = ["qb", "bb"]
    out = "query_id string, label string, block string, bound double"

    only = first if floors is None else None

    def bounds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return V.bounds(left, right, only, per_label)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(bounds, out)
    by = ["query_id", "label"] if per_label else ["query_id"]
    if floors is None:
        w = Window.partitionBy(*by).orderBy(F.desc("bound"), F.asc("block"))
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).select("query_id", "block", "bound")
    named = floors.select(*[F.col(c).alias(f"_{c}") for c in by], "floor")
    kept = found.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left")
    return kept.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 2 * 10.0 ** -V.DIGITS)).select("query_id", "block", "bound")


def score_blocks(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int, per_label: bool) -> DataFrame:
    """The best ``k`` rows of every (query, block) pair, by groups of queries that ask for the same block."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(ASKED_PARTS))
    asked = pairs.select("query_id", "block").join(queries.select("query_id", "vec"), "query_id").withColumn("part", part)
    wanted = asked.select(F.col("block").alias("of"), F.col("part").alias("for_part")).distinct()
    held = wanted.join(blocks.select(F.col("block").alias("of"), "label", "rows", "mat"), "of")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["query_id", "label", "row_id", "sim"])
        block = right.iloc[0]
        rows = np.asarray(block["rows"], dtype=np.int64)
        mat = np.frombuffer(block["mat"], dtype=np.float64).reshape(len(rows), -1)
        return V.best_rows(left["query_id"].to_numpy(), np.stack(left["vec"]).astype(np.float64), rows, np.full(len(rows), block["label"], dtype=object), mat, k, per_label, False)

    return asked.groupBy("block", "part").cogroup(held.groupBy("of", "for_part")).applyInPandas(score, V.CANDIDATE)


def search(queries: DataFrame, blocks: DataFrame, k: int, per_label: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exact top-k over an index of blocks, and the (query, block) pairs that were scored.

    Best blocks first: ``FIRST`` blocks per query (and label) give a floor, the ``k``-th score so far. Then
    only blocks whose bound reaches the floor are scored; no row of another can be among the ``k``.
    Queries are stored; floors, bounds and candidates hold ids and scores.
    """
    q = queries if "targets" in queries.columns else queries.withColumn("targets", F.lit(None).cast("array<string>"))
    q = stored(q.select(F.col("query_id").cast("string").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"), "targets"))
    by = ["query_id", "label"] if per_label else ["query_id"]
    w = Window.partitionBy(*by).orderBy(F.desc("sim"), F.asc("row_id"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    first = stored(block_bounds(q, blocks, None, FIRST, per_label))
    found = stored(ranked(score_blocks(first, q, blocks, k, per_label)))
    floors = found.where(F.col("rank") == k).select(*by, F.col("sim").alias("floor"))
    open_ = block_bounds(q, blocks, floors, FIRST, per_label)
    more = stored(open_.join(first, ["query_id", "block"], "left_anti"))
    rest = score_blocks(more, q, blocks, k, per_label)
    return ranked(found.drop("rank").union(rest)), first.select("query_id", "block").union(more.select("query_id", "block"))


def top_k(queries: DataFrame, index: DataFrame, k: int, per_label: bool = False,
          normalize: bool = True) -> DataFrame:
    """Exact top-k rows per query, or per query and label.

    ``queries`` is ``(query_id, vec[, targets])``; ``targets`` limits the labels a
    query may see (null: all). ``index`` is an exemplar index, or the table of ``index_blocks`` made of one.
    Returns ``(query_id, label, row_id, sim, rank)``.
    """
    blocks = index if "mat" in index.columns else index_blocks(index, normalize)
    return search(queries, blocks, k, per_label)[0].select("query_id", "label", "row_id", "sim", "rank")


def with_vectors(ranked: DataFrame, index: DataFrame, normalize: bool = True) -> DataFrame:
    """Add ``vec`` to ranked rows: only what was picked fetches its vector."""
    vec = V.unit("embedding") if normalize else F.col("embedding").cast("array<double>")
    return ranked.join(index.select("row_id", vec.alias("vec")), "row_id")


def retrieve_for_types(queries: DataFrame, index: DataFrame, k: int = 5, top_n: int = 20,
                       use_mmr: bool = True, lam: float = 0.5) -> DataFrame:
    """Per query and label: the top ``top_n`` rows, then ``k`` of them by relevance or diversity."""
    top = top_k(queries, index, top_n if use_mmr else k, per_label=True)
    if not use_mmr:
        return top.select("query_id", "label", "row_id", "sim", "rank")
    items = with_vectors(top, index).groupBy("query_id", "label").agg(
        F.array_sort(F.collect_list(F.struct("rank", "row_id", "sim", "vec"))).alias("items"))
    picked = pos_rows(items, V.mmr("items", k, lam), "query_id", "label")
    return picked.select("query_id", "label", F.col("x.row_id").alias("row_id"), F.col("x.sim").alias("sim"),
                         (F.col("pos") + 1).alias("rank"))


def without_query(targets: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """Fallback when a case has no query vector: the first ``k`` rows of each target label."""
    w = Window.partitionBy("label").orderBy("row_id")
    first = index.select("label", "row_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return targets.join(first, "label")


def retrieve_pooled(queries: DataFrame, index: DataFrame, k: int = 15, normalize: bool = True) -> DataFrame:
    """One ranked list per query over the union of its target labels."""
    return top_k(queries, index, k, normalize=normalize).select("query_id", "label", "row_id", "sim", "rank")


def pooled_budget(queries: DataFrame, index: DataFrame, k: int = 5, cap: int = 100) -> DataFrame:
    """Pool ``min(k * n_targets, cap)`` rows, keep the best per id, then at most ``k`` per label."""
    sizes = queries.select("query_id", F.least(F.size("targets") * k, F.lit(cap)).alias("budget"))
    pooled = top_k(queries, index, cap).join(sizes, "query_id").where("rank <= budget")
    best = Window.partitionBy("query_id", "row_id").orderBy("rank")
    once = pooled.withColumn("seen", F.row_number().over(best)).where("seen = 1")
    w = Window.partitionBy("query_id", "label").orderBy("rank")
    return once.withColumn("bucket_rank", F.row_number().over(w)).where(F.col("bucket_rank") <= k).select(
        "query_id", "label", "row_id", "rank", "bucket_rank")


def nearest_trophies(queries: DataFrame, index: DataFrame, k: int = 3, min_sim: float = 0.4) -> DataFrame:
    """The ``k`` nearest rows that reach ``min_sim``; the target set leaves the own row out."""
    return retrieve_pooled(queries, index, k).where(F.col("sim") >= min_sim).withColumn(
        "sim", F.round("sim", 3))


def hydrate(ranked: DataFrame, pool: DataFrame, how: str = "inner") -> DataFrame:
    """Attach pool records to ranked ids; ``left`` keeps ids the pool does not know."""
    return ranked.join(pool, "id", how)


def anchor_ids(exemplars: Column) -> Column:
    ids = F.transform(exemplars, lambda x: x["id"])
    return F.filter(ids, lambda i: i.isNotNull() & (i != ""))
