"""Operators 11, 12 and 13: against plain loops, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, docs, prose

from changelens.llm import op11_lexical as op11
from changelens.llm import op12_lloyd as op12
from changelens.llm import op13_toxicity as op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(rows, items, top):
    counts = [(d, Counter(terms(t))) for d, t in rows]
    lens = [c.total() for _, c in counts]
    n, total = sum(x > 0 for x in lens), sum(lens)
    out = []
    for item, text in items:
        asked = terms(text)
        df = {t: sum(t in c for _, c in counts) for t in set(asked)}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in df}
        scored = []
        for (d, c), k in zip(counts, lens, strict=True):
            m = 25 + (75 * k * n) // total if total else 0
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, small):
    texts = [prose(r, i % 9) for i, r in enumerate([5, 40, 40, 40, 7, 7, 80, 3, 9, 200])] + [None, "", "Été-42 é42 ÉTÉ", "A a A", "漢字 漢字"]
    df = awkward(docs(spark, texts))
    items = [(1, "the of " + prose(6, 2)), (2, prose(4, 1)), (2, prose(4, 1)), (3, None), (4, "nowherewhatever"), (5, "é42 a A 漢字"), (None, prose(5, 3)), (7, "")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank")
    if small:  # texts in pieces, few scores at once, several blocks of items
        monkeypatch.setattr(op11, "PIECE_BYTES", 7)
        monkeypatch.setattr(op11, "CELLS", 3)
    got = op11.search(df, asked, 3, 60 if small else op11.BLOCK_BYTES)
    want = plain_search([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], items, 3)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == want
    assert op11.search(df.limit(0), asked).count() == 0 and op11.search(df, asked.limit(0)).count() == 0


def plain_clusters(rows, k, rounds, dims, seed):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in start]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), c


@pytest.mark.parametrize("tile,block", [(2048, 16), (3, 5)])
def test_clusters(spark, monkeypatch, tile, block):
    monkeypatch.setattr(op12, "TILE_ROWS", tile)
    r = np.random.default_rng(2)
    v = (r.normal(size=(80, 12)) + r.integers(0, 4, (80, 1)) * 2).astype(np.float32).tolist()
    v[40:70] = [v[40]] * 30  # a hot vector
    rows = [(i, x) for i, x in enumerate(v)] + [(5, v[3]), (None, v[4]), (100, None), (101, [1.0]), (102, [float("nan")] * 12), (103, [float("inf")] * 12), (104, [None] * 12), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS tile", "3 AS x").repartition(3)
    want, centroids = plain_clusters(rows, 8, 4, 12, 3)
    found, c = op12.cluster(df, rounds=4, dims=12)
    assert c.tolist() == centroids
    assert sorted(map(tuple, found.collect()), key=repr) == want
    rep = op12.report(found, c).collect()
    assert {x.inertia for x in rep} == {sum(d for *_, d in want)}
    assert all(x.cluster_inertia == sum(d for _, k, d in want if k == x.cluster) for x in rep)
    assert all(x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest() for x in rep)
    near = op12.assign(op12.tiles(op12.kept(df, 12), 12, block), c, block)  # other blocks, same sums
    assert sum(op12._wide(x.distance).sum() for x in near.collect()) == sum(d for *_, d in want)
    assert op12.report(*op12.cluster(df.limit(0), dims=12)).count() == 0
    few, c = op12.cluster(df.filter("vec_id < 3"), rounds=2, dims=12)
    assert len(c) == 3 and few.count() == 3
    with pytest.raises(Exception, match="2\\*\\*27"):
        op12.cluster(spark.createDataFrame([(1, [1e30] * 12)], "vec_id long, embedding array<float>"), dims=12)


LEXICON = op13.Lexicon({" idiot ": 5.0, " scum ": 4.0, " trash ": 4.0, " iowe": 6.0}, -2.0, 100.0, ["trash can"])


def test_folding_exceptions_and_length():
    score = LEXICON.scorer()
    base = score(b"")
    assert base == (1 / (1 + math.exp(2)), 0) and score(b" ... ") == base
    for text in ("IDIOT", "1d1ot!", "іdіot", "ｉｄｉｏｔ", "id​iot", "an idiot.", "loweihr"):
        assert score(text.encode())[1] == 1, text
    for text in ("idiotic", "sidiot", "a trash can", "TRASH\ncan", "oweihr"):
        assert score(text.encode()) == base, text
    assert score(b"trash can trash")[1] == 1
    assert score(b"idiot scum")[0] > score(b"idiot")[0] == score(b"idiot idiot")[0]
    assert score(b"idiot " + b"word " * 5000)[0] < score(b"idiot " + b"word " * 90)[0]
    assert score(b"x " * 2_000_000 + b"idiot")[1] == 1


def test_learned_from_labels_that_are_not_held_out(spark):
    texts = [prose(60, i) + (" blorx" if i % 4 == 0 else "") + (f" quum{i % 7}a" if i % 4 == 2 else "") for i in range(400)]
    toxic = [int(i % 2 == 0) for i in range(400)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(3, 1, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    lexicon = op13.learn(df, labels)
    assert set(lexicon.weights) == {" biorx ", " quum"}
    got = {r.doc_id: r for r in op13.toxicity(df, lexicon).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == toxic[i] for i in range(400))
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    assert op13.learn(df, flipped).weights == lexicon.weights  # held-out labels are never read
    rows = awkward(df)
    out = op13.toxicity(rows, lexicon)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "n_entries"] and out.count() == rows.count()
    assert op13.learn(rows, labels).weights and not op13.learn(df.limit(0), labels).weights and not op13.learn(df, labels.limit(0)).weights
    assert op13.toxicity(df.limit(0), lexicon).count() == 0
    assert {r.held_out for r in out.filter("doc_id IS NULL").collect()} == {False}


@pytest.mark.parametrize("sf,recall", [("sf0.01", 0.7)])
def test_held_out_accuracy(spark, sf, recall):
    documents, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = op13.toxicity(documents, op13.learn(documents, labels)).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in found if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= recall * len(toxic)
    assert sum(r.predicted for r in found if r.toxic == 0) <= 0.01 * len(found)
