"""Vector expressions and the top-k kernel that runs inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions.rows import let
from changelens.functions.text import _c

EPS = 1e-8
DIGITS = 9  # similarities are ranked at this precision, so equal vectors tie


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(col) -> Column:
    """Unit-length double vector; a vector shorter than the epsilon stays tiny."""
    v = F.transform(_c(col), lambda x: x.cast("double"))
    return let(v, lambda w: F.transform(w, lambda x: x / F.greatest(F.sqrt(dot(w, w)), F.lit(EPS))))


def scale(col, factor: float) -> Column:
    return F.transform(_c(col), lambda x: x.cast("double") * F.lit(float(factor)))


def mean_vector(col, dim: int) -> Column:
    """Component-wise mean as one aggregate: no explode, partial sums per task."""
    return F.array(*[F.avg(F.get(_c(col), F.lit(i)).cast("double")) for i in range(dim)])


def mmr(items, k: int, lam: float = 0.5) -> Column:
    """Pick ``k`` of ``array<struct<sim,vec,...>>`` by maximal marginal relevance.

    The array is ordered by relevance and already cut to the top n, so the fold
    works on a short row. With at most ``k`` elements the input order is kept.
    """
    arr = _c(items)
    size = F.size(arr)
    start = F.struct(
        F.array(F.lit(0)).alias("sel"),
        F.transform(arr, lambda x: F.round(dot(x["vec"], F.get(arr, F.lit(0))["vec"]), DIGITS)).alias("pen"),
    )

    def step(acc: Column, _i: Column) -> Column:
        scores = F.transform(arr, lambda x, i: F.when(
            F.array_contains(acc["sel"], i), F.lit(-1e18)
        ).otherwise(F.round(x["sim"] * lam - F.get(acc["pen"], i) * (1.0 - lam), DIGITS)))
        best = let(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))
        return let(best, lambda b: F.struct(
            F.array_append(acc["sel"], b).alias("sel"),
            F.zip_with(acc["pen"], arr, lambda p, x: F.greatest(
                p, F.round(dot(x["vec"], F.get(arr, b)["vec"]), DIGITS))).alias("pen")))

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), start, step)["sel"]
    chosen = F.transform(picked, lambda i: F.get(arr, i))
    return F.when(size <= k, arr).otherwise(chosen)


# Kernel

CANDIDATE = "query_id string, label string, row_id bigint, sim double"


BLOCK = "block string, label string, n int, centre array<double>, radius double, rows array<bigint>, mat binary"


def balls(rows, label, vectors, chunk, block_rows, normalize):
    """Divide the rows of a chunk by their nearest local pivots: one block of similar vectors per pivot.

    Pivots are rows far from each other: each next one is the row that is furthest from those before.
    """
    order = np.argsort(rows, kind="stable")
    rows, vectors = rows[order], vectors[order]
    if normalize:
        vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), EPS)
    near, away = np.zeros(len(rows), dtype=int), np.full(len(rows), np.inf)
    for i in range(-(-len(rows) // block_rows)):
        pivot = vectors[0 if i == 0 else int(away.argmax())]
        d = np.square(vectors - pivot).sum(axis=1)
        near[d < away] = i
        away = np.minimum(d, away)
    out = []
    for i in np.unique(near):
        own, names = vectors[near == i], rows[near == i]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(np.square(own - centre).sum(axis=1)).max())
        out.append((f"{label}/{chunk}/{i}", label, len(names), centre.tolist(), radius, names.tolist(), np.ascontiguousarray(own).tobytes()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in BLOCK.split(", ")])


def bounds(queries, blocks, first, per_label):
    """``(query_id, label, block, bound)`` of all blocks a query may see, or of the ``first`` best ones per query (and label)."""
    columns = ["query_id", "label", "block", "bound"]
    if queries.empty or blocks.empty:
        return pd.DataFrame(columns=columns)
    q = np.stack(queries["vec"]).astype(np.float64)
    top = q @ np.stack(blocks["centre"]).astype(np.float64).T
    top += np.linalg.norm(q, axis=1)[:, None] * blocks["radius"].to_numpy()[None, :]
    labels = blocks["label"].to_numpy()
    for i, targets in enumerate(queries["targets"]):
        if targets is not None:
            top[i, ~np.isin(labels, np.asarray(targets, dtype=object))] = -np.inf
    ids, names = queries["query_id"].to_numpy(), blocks["block"].to_numpy()
    if first is not None:
        codes = pd.factorize(labels, use_na_sentinel=False)[0] if per_label else np.zeros(len(labels), dtype=int)
        keep = np.zeros(top.shape, dtype=bool)
        for code in range(codes.max() + 1):
            cols = np.flatnonzero(codes == code)
            at = np.argsort(-top[:, cols], axis=1, kind="stable")[:, :first]
            keep[np.arange(len(top))[:, None], cols[at]] = True
    else:
        keep = np.ones(top.shape, dtype=bool)
    i, j = np.nonzero(keep & np.isfinite(top))
    return pd.DataFrame({"query_id": ids[i], "label": labels[j], "block": names[j], "bound": top[i, j]})


def best_rows(query_ids, queries, rows, labels, vectors, k, per_label, normalize=True):
    """Exact top-k of one batch for every query (and label), ties by row id; never all pairs."""
    order = np.argsort(rows, kind="stable")
    rows, labels, vectors = rows[order], labels[order], vectors[order]
    if normalize:
        vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), EPS)
    sims = np.round(queries @ vectors.T, DIGITS)
    codes = pd.factorize(labels, use_na_sentinel=False)[0] if per_label else np.zeros(len(labels), dtype=int)
    q_at, c_at = [], []
    for code in range(codes.max() + 1):
        cols = np.flatnonzero(codes == code)
        picked_q, picked_c = _largest(sims[:, cols], k)
        q_at.append(picked_q)
        c_at.append(cols[picked_c])
    qs, cs = np.concatenate(q_at), np.concatenate(c_at)
    return pd.DataFrame({
        "query_id": np.asarray(query_ids, dtype=object)[qs], "label": labels[cs], "row_id": rows[cs], "sim": sims[qs, cs]})


def _largest(part, k):
    """Positions of the ``k`` largest values per row; of equal values the first columns win."""
    k = min(k, part.shape[1])
    edge = -np.partition(-part, k - 1, axis=1)[:, k - 1:k]
    above, equal = part > edge, part == edge
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))
