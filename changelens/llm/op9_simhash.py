"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within TAU differing bits are linked. The 64 bits are cut into m groups, bits that correlate
going into the same group, and group i gets a threshold t_i >= -1 with sum(t_i + 1) = TAU + 1: two
fingerprints further apart than t_i in every group differ in more than TAU bits, so every linked pair
meets in some group within its threshold. m and the thresholds are chosen by dynamic programming on the
work they are expected to make: probes, and candidate pairs estimated on a bounded sample of fingerprints
(SAMPLE). The sample steers the work alone; links are exact whatever it holds.

Only distinct fingerprints are probed. Those that meet under a group's value are compared by bit counts
and emit a spanning forest of their links, fewer links than fingerprints: the same components, no pairs
of a group of near copies. Of two values that differ in a threshold's bits, the one whose lowest such bit is 0 probes.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows
and copies share a fingerprint; a component whose ids are all null has component_id null; an empty table gives no
rows; extra columns pass through `one_per_group` and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import key, map_rows, packed, stored
from changelens.llm.components import components

TAU = 4
SHINGLE = 4
#: Fingerprints, chosen by hash, on which the candidate counts are estimated.
SAMPLE = 4096
#: Relative cost of exchanging one probe and of comparing one pair.
PROBE_COST, PAIR_COST = 1.0, 0.003


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    firsts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    h = xxhash.xxh64_intdigest
    return majority(np.fromiter((h(joined[a:b], 42) for a, b in zip(firsts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if set in over half of them."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the row's key) and fp, the fingerprint as a signed long."""

    def make():
        def run(texts, batch):
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            return [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(fps)]

        return run

    return map_rows(docs.select("doc_id", "text", *key()), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, fp long")


def bit_groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of nearly equal size; each takes the free bit that correlates most with those it has."""
    with np.errstate(all="ignore"):
        like = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    free, out = set(range(64)), []
    for g in range(m):
        size = (64 - sum(map(len, out)) + m - g - 1) // (m - g)
        own = [max(free, key=lambda b: (like[b, sorted(free)].sum(), -b))]
        free.discard(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (like[b, own].sum(), -b)))
            free.discard(own[-1])
        out.append(sorted(own))
    return out


def _near(fps: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0..most bits of the group: as counted, at least as independent bits would."""
    part = fps & np.uint64(sum(1 << b for b in group))
    seen = np.zeros(65)
    for i in range(0, len(part), 256):
        seen += np.bincount(np.bitwise_count(part[i : i + 256, None] ^ part[None, :]).ravel(), minlength=65)
    n = len(part)
    seen[0] -= n
    counted = np.cumsum(seen) / max(1, n * (n - 1))
    ones = np.array([((fps >> np.uint64(b)) & np.uint64(1)).mean() if n else 0.5 for b in group])
    apart = np.array([1.0])
    for q in 2 * ones * (1 - ones):
        apart = np.convolve(apart, [1 - q, q])
    return [max(float(counted[e]), float(apart[: e + 1].sum())) for e in range(most + 1)]


def choose(fps: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds, those without work left out: the cheapest over 1..tau+1 groups for n fingerprints."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, tau + 2):
        groups = bit_groups(bits, m)
        state: dict[int, tuple[float, list]] = {0: (0.0, [])}  # by the sum of t + 1 so far
        for g in groups:
            near = _near(fps, g, min(2, tau))
            new: dict[int, tuple[float, list]] = {}
            for used, (cost, chosen) in state.items():
                for t in range(-1, min(3, tau + 1 - used)):
                    probes = 0 if t < 0 else 1 + sum(comb(len(g), k) for k in range(1, t + 1)) / 2
                    more = cost + n * probes * PROBE_COST + (n * n / 2 * near[t] * PAIR_COST if t >= 0 else 0)
                    if used + t + 1 not in new or more < new[used + t + 1][0]:
                        new[used + t + 1] = (more, [*chosen, (g, t)])
            state = new
        if tau + 1 in state and state[tau + 1][0] < best[0]:
            best = state[tau + 1]
    return [(g, t) for g, t in best[1] if t >= 0]


def probes(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp): each fingerprint under its own value of every group and under the values it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i, (group, t) in enumerate(plan):
                own = fps & np.uint64(sum(1 << x for x in group))
                for k in range(t + 1):
                    for flips in combinations(group, k):
                        ask = (fps & np.uint64(1 << flips[0])) == 0 if flips else np.ones(len(fps), bool)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(ask.sum(), i, np.int32)), pa.array((own[ask] ^ np.uint64(sum(1 << x for x in flips))).view(np.int64)), pa.array(fps[ask].view(np.int64))], ["part", "value", "fp"])

    return distinct.select("fp").mapInArrow(run, "part int, value long, fp long")


def forest(x: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints; holds 8 bytes for each of them and a round of flags."""
    if len(x) <= 256:  # most small sets have no link at all
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= tau
        x = x[near.sum(axis=1) > 1]
    a, b = [], []
    while len(x) > 1:
        queue, x = [x[0]], x[1:]
        while queue and len(x):
            node = queue.pop()
            near = np.bitwise_count(x ^ node) <= tau
            if near.any():
                found = x[near]
                a.append(np.full(len(found), node))
                b.append(found)
                queue.extend(found)
                x = x[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], tau: int = TAU) -> DataFrame:
    """(a, b) that connect exactly the fingerprints within tau bits, though not by every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(part, value, fp):
            edge = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1])) + 1
            edge = np.concatenate([[0], edge, [len(part)]])
            found = [forest(fp[i:j].view(np.uint64), tau) for i, j in zip(edge[:-1], edge[1:], strict=True) if j - i > 1]
            for x, y in [f for f in found if len(f[0])]:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for b in batches:
            now = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "fp"))
            if not len(now[0]):
                continue
            if held and held[-1][0][-1] == now[0][-1] and held[-1][1][-1] == now[1][-1]:
                held.append(now)  # still the same value
                continue
            part, value, fp = (np.concatenate(x) for x in zip(*held, now, strict=True)) if held else now
            cut = len(part) - int(np.argmax((part[::-1] != part[-1]) | (value[::-1] != value[-1]))) if part[0] != part[-1] or value[0] != value[-1] else 0
            if cut:
                yield from out(part[:cut], value[:cut], fp[:cut])
            held = [(part[cut:], value[cut:], fp[cut:])]
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return probes(distinct, plan).repartition("part", "value").sortWithinPartitions("part", "value").mapInArrow(run, "a long, b long")


def searched(distinct: DataFrame, tau: int = TAU) -> DataFrame:
    """`links` of distinct fingerprints, the bit groups chosen on a sample of them."""
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    return links(distinct, choose(sample, distinct.count(), tau), tau)


def classes(found: DataFrame, tau: int = TAU) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of a stored fingerprint table."""
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    star = components(searched(distinct, tau))
    rooted = distinct.join(star.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links) for every document."""
    found = stored(fingerprints(docs), "fingerprints")
    return found.join(classes(found, tau), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id; of rows equal in id and text one."""
    found = stored(fingerprints(docs), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull(), "k1", "k2")).alias("best")
    kept = found.join(classes(found, tau), "fp").groupBy("root").agg(best).select("best.k1", "best.k2")
    k1, k2 = key()
    return packed(docs, k1=k1, k2=k2).join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
