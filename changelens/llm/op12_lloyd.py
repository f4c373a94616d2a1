"""Centroid clustering: Lloyd's rounds with the dimensions in shards.

Components become integers, so every sum and distance is exact and the same on any number of tasks. The kept
vectors are stored as tiles: TILE_ROWS vectors by a block of at most BLOCK_DIMS dimensions. In a round

1. a task for a column block works out the partial squared distances of its tiles to its slice of every centroid;
2. the partial distances of a row group are added over the blocks, and each vector takes the nearest
   centroid (ties: the smaller number); only these sums are exchanged, in the narrowest integers that hold them;
3. each block's tiles meet the assignment, are summed by centroid inside the tasks, and one row per block
   and task makes the block's new slice: the floor of sum over count, the old slice for a centroid without vectors.

Assignments are a stored table in every round, so a lost executor repeats one step. The driver holds the slices
(k x dimensions) and nothing that grows with the vectors. No vector is grouped by value, so a vector that a
third of all rows repeat is spread like any other.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out; repeated ids
are vectors of their own, a null id hashes as an empty one; with fewer vectors than centroids there are fewer centroids; an empty
table gives no rows; extra columns are not read. Scaled components must be smaller than 2**27 in size, so that distances
fit a long: others raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm.common import stored

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
TILE_ROWS, BLOCK_DIMS = 2048, 16
MOST = 1 << 27


def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and x (integers) of the vectors with `dims` finite components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = (F.size("embedding") == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    small = F.forall(x, lambda v: F.abs(F.floor(v * scale)) < MOST)
    ints = F.when(small, F.transform(x, lambda v: F.floor(v * scale).cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {scale} is not below 2**27")).cast("array<int>"))
    return vectors.filter(F.col("embedding").isNotNull()).filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("x"))


def tiles(rows: DataFrame, dims: int = DIMS, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """The stored tiles: tile (row group), block, ids (its vectors), x (row by row, 32-bit integers). A task's rows are cut into groups."""
    ids = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        held_ids: list = []
        held_x: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal no
            x = np.concatenate(held_x)
            blocks = range(0, dims, block_dims)
            name = (part << 32) + no
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array([held_ids] + [None] * (len(blocks) - 1), ids),
                                              pa.array([np.ascontiguousarray(x[:, b : b + block_dims]).tobytes() for b in blocks], pa.binary())], ["tile", "block", "ids", "x"])
            no += 1
            held_ids.clear()
            held_x.clear()

        for b in batches:
            names = b.column("vec_id").to_pylist()
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(names), dims)
            at = 0
            while at < len(names):
                n = min(len(names) - at, TILE_ROWS - len(held_ids))
                held_ids += names[at : at + n]
                held_x.append(x[at : at + n])
                at += n
                if len(held_ids) == TILE_ROWS:
                    yield from out()
        if held_ids:
            yield from out()

    return stored(rows.mapInArrow(run, "tile long, block int, ids array<long>, x binary"), "tiles")


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hash of their id (of equal ids those with the smallest components first)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in rows.orderBy(name, "x").limit(k).collect()], np.int64)


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, width).astype(np.int64)


def _narrow(a: np.ndarray) -> bytes:
    """Integers from 0 in the narrowest size that holds them; the first byte is the size."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or a.max(initial=0) < 1 << (8 * s))
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _partial(slices: np.ndarray, block_dims: int):
    """Partial squared distances of every tile to its block's slice of the centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block, data in zip(b.column("block").to_pylist(), b.column("x").to_pylist(), strict=True):
                c = slices[:, block * block_dims : (block + 1) * block_dims]
                x = _matrix(data, c.shape[1])
                out.append(_narrow(np.stack([np.square(x - own).sum(axis=1) for own in c], axis=1)))
            yield pa.RecordBatch.from_arrays([b.column("tile"), pa.array(out, pa.binary())], ["tile", "part"])

    return run


def _nearest(k: int):
    """Adds the partial distances of a row group, which stand together, and picks the nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, total = None, None

        def out() -> pa.RecordBatch:
            d = total.reshape(-1, k)
            near = d.argmin(axis=1)  # the first of equal ones
            return pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([_narrow(near)], pa.binary()), pa.array([_narrow(d[np.arange(len(d)), near])], pa.binary())], ["tile", "near", "distance"])

        for b in batches:
            for t, part in zip(b.column("tile").to_pylist(), b.column("part").to_pylist(), strict=True):
                if t != tile:
                    if tile is not None:
                        yield out()
                    tile, total = t, np.zeros_like(_wide(part))
                total = total + _wide(part)
        if tile is not None:
            yield out()

    return run


def assign(held: DataFrame, centroids: np.ndarray, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """The stored (tile, near, distance): the nearest centroid of each vector of a row group and the squared distance."""
    parts = held.select("tile", "block", "x").mapInArrow(_partial(centroids, block_dims), "tile long, part binary")
    together = parts.repartition("tile").sortWithinPartitions("tile")
    return stored(together.mapInArrow(_nearest(len(centroids)), "tile long, near binary, distance binary"), "near")


def moved(held: DataFrame, near: DataFrame, centroids: np.ndarray, block_dims: int = BLOCK_DIMS) -> np.ndarray:
    """The new centroids. A task sums its tiles by block and centroid first: k rows for each block it saw."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data, own in zip(*(b.column(c).to_pylist() for c in ("block", "x", "near")), strict=True):
                width = min(block_dims, dims - block * block_dims)
                x, at = _matrix(data, width), _wide(own)
                add = np.zeros((k, width + 1), np.int64)
                np.add.at(add, at, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
                total[block] = total.get(block, 0) + add
        rows = [(block, c, a[c].tolist()) for block, a in total.items() for c in range(k)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["block", "c", "sums"])

    found = held.select("tile", "block", "x").join(near.select("tile", "near"), "tile").select("block", "x", "near").mapInArrow(sums, "block int, c int, sums array<long>")
    widest = min(block_dims, dims) + 1
    added = found.groupBy("block", "c").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(widest)])
    out = centroids.copy()
    for r in added.collect():  # k x blocks rows
        values = [v for v in r[2:] if v is not None]
        if values[-1]:
            out[r.c, r.block * block_dims : r.block * block_dims + len(values) - 1] = [v // values[-1] for v in values[:-1]]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after `rounds` rounds and one more assignment, and the centroids."""
    rows = kept(vectors, dims, scale)
    held = tiles(rows, dims)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids.reshape(0, dims)
    for _ in range(rounds):
        centroids = moved(held, assign(held, centroids), centroids)
    near = assign(held, centroids)

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, at, d in zip(*(b.column(c).to_pylist() for c in ("ids", "near", "distance")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(_wide(at).astype(np.int32)), pa.array(_wide(d))], ["vec_id", "cluster", "distance"])

    named = held.filter("block = 0").select("tile", "ids").join(near, "tile").select("ids", "near", "distance")
    return stored(named.mapInArrow(vectors_of, "vec_id long, cluster int, distance long"), "clusters"), centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors with cluster_inertia, inertia (sums of distances) and centroid_sha256 (of the components in decimal, joined by commas)."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("centroid_sha256", T.StringType())])
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row for each centroid
    all_ = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    sums = sums.join(found.sparkSession.createDataFrame(list(enumerate(names)), schema), "cluster").withColumn("inertia", all_.scalar())
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
