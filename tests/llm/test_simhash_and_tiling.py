"""Operators 9 and 2 against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import awkward, docs, prose
from pyspark.sql import functions as F

from changelens.llm import op2_decontaminate as op2
from changelens.llm import op9_simhash as op9


def plain_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def copies():
    r = random.Random(5)
    out = []
    for s in range(30):
        text = prose(200, s)
        for _ in range(r.choice([1, 1, 2, 6])):
            words = text.split()
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = "edit" + str(r.random())
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("texts", [None, copies()])
@pytest.mark.parametrize("change", [lambda d: d, awkward])
def test_near_duplicates(spark, texts, change):
    df = change(docs(spark, texts))
    got = sorted(map(tuple, op9.near_duplicates(df).collect()), key=repr)
    assert got == plain_components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    kept = op9.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in got})


def test_empty_simhash(spark):
    assert op9.near_duplicates(docs(spark).limit(0)).count() == 0
    assert op9.one_per_group(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("plan_for", [50, 10**6, 10**9, 10**13])
def test_links_are_exact_under_any_plan(spark, plan_for):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:25].tolist():
        for _ in range(30):
            fps.add(b ^ sum(1 << int(x) for x in set(r.integers(0, 64, r.integers(1, 7)).tolist())))
    x = np.array(sorted(fps), np.uint64)
    plan = op9.choose(x, plan_for)
    assert sum(t + 1 for _, t in plan) == op9.TAU + 1
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    edges = [tuple(e) for e in op9.links(df, plan).collect()]
    assert all((a ^ b & 2**64 - 1).bit_count() <= 4 or ((a ^ b) & 2**64 - 1).bit_count() <= 4 for a, b in edges)

    def classes(pairs):
        root = {int(v): int(v) for v in x.view(np.int64)}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for v in root:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert classes(edges) == classes([(int(x.view(np.int64)[i]), int(x.view(np.int64)[j])) for i, j in near])


def plain_coverage(item, doc):
    a, b = op2.words((item or "").encode()), op2.words((doc or "").encode())
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < op2.SEED:
            return total
        ma[i : i + k], mb[j : j + k] = [True] * k, [True] * k
        total += k


def test_tiling_against_plain_search(spark):
    r = random.Random(1)
    items = [prose(n, 50 + n) for n in (3, 4, 12, 30, 36)] + ["la la la la la la la la", None, ""]
    texts = []
    for k in range(24):
        parts = prose(40, 100 + k).split()
        for it in r.sample(items[1:6], 2):
            w = it.split()
            cut = sorted(r.sample(range(len(w)), min(2, len(w) - 1)))
            pieces = [w[: cut[0]], w[cut[0] : cut[-1]], w[cut[-1] :]]
            r.shuffle(pieces)
            at = r.randrange(len(parts))
            parts[at:at] = [x for p in pieces[: r.randint(1, 3)] for x in p]
        texts.append(" ".join(parts))
    texts += [items[4], items[4].upper() + "!", None, "", "la " * 30]
    df = docs(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        for i, it in enumerate(items):
            n, total = plain_coverage(it, t), len(op2.words((it or "").encode()))
            if total >= op2.SEED and n >= op2.COVERAGE * total:
                want[d, i] = (total, n)
    for words in (op2.BLOCK_WORDS, 5):
        assert {(x.doc_id, x.item_id): (x.n_item_words, x.n_tiled) for x in op2.leaks(df, bench, block_words=words).collect()} == want
        kept = op2.clean(awkward(df), bench, block_words=words)
        assert kept.columns == awkward(df).columns
        assert Counter(x.doc_id for x in kept.collect()) == Counter(x.doc_id for x in awkward(df).filter(~F.col("doc_id").isin([d for d, _ in want])).collect()) + Counter({None: 0 if (0, 4) in want or any(d == 0 for d, _ in want) else 1})
    assert op2.leaks(df.limit(0), bench).count() == 0 and op2.leaks(df, bench.limit(0)).count() == 0
    assert op2.clean(df, bench.limit(0)).count() == len(texts)


def test_reordered_passage_is_found():
    item = prose(36, 9).split()
    moved = item[18:] + item[:9] + item[9:18]
    block = op2.Block([(7, " ".join(item).encode())])
    assert op2.compare(block, f"{prose(50, 1)} {' '.join(moved)} {prose(50, 2)}".encode(), 0.9)[0][0] == 7
    assert op2.compare(block, prose(500, 3).encode(), 0.5) == []


def test_tiles_by_windows_are_those_of_all_matches():
    for seed in range(1500):
        r = random.Random(seed)
        k = r.choice([1, 2, 3, 5])
        item = np.array([r.randrange(k) for _ in range(r.randint(0, 25))], np.int64)
        doc = np.array([r.choice([-1, *range(k)]) for _ in range(r.randint(0, 40))], np.int64)
        own, h = op2.rolling(item), op2.rolling(doc)
        pairs = [(p, d) for p in range(len(own)) for d in range(len(h)) if h[d] and own[p] == h[d]]
        want = op2.tiles(op2.matches(item, doc, *(np.array(x, np.int64) for x in zip(*pairs, strict=True))), len(item), len(doc)) if pairs else []
        assert sorted(op2.long_tiles(item, doc)) == sorted(want)


def test_seeds_of_neighbouring_numbers_differ():
    seeds = op2.rolling(np.array([0, 0, 0, 0, 0, 0, 0, 1], np.int64))
    assert seeds[0] != seeds[4]


def test_repeated_words_need_memory_in_proportion():
    import tracemalloc

    block = op2.Block([(1, b"ha " * 2000), (2, b"ha ho " * 500)])
    text = b"ha " * 350_000
    tracemalloc.start()
    assert op2.compare(block, text, 0.5) == [(1, 2000, 2000, 1, 2000)]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
