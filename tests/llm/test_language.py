"""Operator 3: accuracy on held-out rows, the value of each kind of evidence, awkward rows."""

import pytest
from helpers import awkward, docs
from pyspark.sql import functions as F

from changelens.llm import op3_language as op3

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")


def test_held_out_accuracy(spark, tables):
    documents, pages = tables
    odd = documents.filter("doc_id % 2 = 1")
    even = documents.filter("doc_id % 2 = 0").withColumn("lang", F.lit(None).cast("string"))  # labels held out
    got = {r.doc_id: r for r in op3.identify(odd.union(even), pages).filter("doc_id % 2 = 0").collect()}
    want = {r.doc_id: r.lang for r in documents.filter("doc_id % 2 = 0 AND length(text) > 20").collect()}
    right = sum(got[d].language == x for d, x in want.items())
    assert right >= 0.98 * len(want)
    assert sum(got[d].accepted for d in want) >= 0.99 * len(want)


def test_pages(spark, tables):
    got = {r.page_id: r for r in op3.identify(*tables).filter("page_id IS NOT NULL").collect()}
    pages = tables[1].collect()
    assert len(got) == len(pages)
    right = sum(got[p.page_id].language == got[p.page_id].declared for p in pages)
    assert right >= 0.95 * len(pages)


def test_evidence_counts(spark, tables):
    documents = tables[0]
    en, de = (documents.filter(f"lang = '{x}' AND length(text) > 200").limit(40).collect() for x in ("en", "de"))
    html = lambda text, lang: f'<html lang="{lang}"><p>{text}</p>'
    rows = [(i, f"http://a.example.de/{i}", html(r.text, "de")) for i, r in enumerate(de)] + [(100 + i, f"http://b.example.com/{i}", html(r.text, "en")) for i, r in enumerate(en)]
    vague = html("er", "xx")
    rows += [(900, "http://a.example.de/x", vague), (901, "http://b.example.com/x", vague), (902, "http://other.example.de/", vague), (903, None, html("er", "de")), (904, "no url", None), (905, "http://a.example.de/", html("12 34", "de"))]
    got = {r.page_id: r for r in op3.identify(documents, spark.createDataFrame(rows, "page_id long, url string, html string")).filter("page_id IS NOT NULL").collect()}
    assert [got[i].language for i in (900, 901, 902, 903)] == ["de", "en", "de", "de"]  # host, host, domain and suffix, markup
    assert (got[904].language, got[904].accepted, got[904].host) == ("und", False, None)
    assert (got[905].language, got[905].accepted, got[905].confidence) == ("und", False, 1.0)


@pytest.mark.parametrize("hosts", [0, 20_000])
def test_awkward(spark, monkeypatch, hosts):
    monkeypatch.setattr(op3, "BROADCAST_HOSTS", hosts)
    df = awkward(docs(spark))
    pages = spark.createDataFrame([(1, None, None), (1, "http://x.y.de/", ""), (None, "https://u:p@Host.Example.org:80/a", "<HTML class=a LANG='de-AT'>")], "page_id long, url string, html string")
    rows = op3.identify(df, pages).collect()
    assert len(rows) == df.count() + 3
    assert {(r.host, r.domain, r.suffix, r.declared) for r in rows if r.page_id is None and r.doc_id is None and not (r.host or "").startswith("source:")} == {("host.example.org", "example.org", "org", "de")}
    assert all(0 <= r.confidence <= 1 for r in rows)
    kept = op3.keep_known(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    assert None not in texts and "" not in texts and " \n\t " not in texts
    assert op3.identify(df.limit(0), pages.limit(0)).count() == 0
    assert op3.keep_known(df.limit(0)).count() == 0
    none = op3.identify(df.withColumn("lang", F.lit(None).cast("string")), pages)
    assert {r.language for r in none.collect()} == {"und"}


def plain_posteriors(rows, label_of):
    """Languages of (text, source) rows by a plain loop over the same formulas."""
    import numpy as np

    names = sorted({x for x in label_of if x is not None})
    counts = np.zeros((len(names), op3.FEATURES))
    grams = []
    for (text, _), lang in zip(rows, label_of, strict=True):
        h = op3.features([text.encode()])[0][: len(text.encode()) + 3]
        grams.append(h)
        if lang is not None:
            np.add.at(counts[names.index(lang)], h, 1)
    counts[:, op3._BLANK] = 0
    like = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * op3.FEATURES))
    like = np.concatenate([like, np.full((1, op3.FEATURES), -np.log(op3.FEATURES))])
    like[:, op3._BLANK] = 0
    score = np.array([like[:, h].sum(axis=1) / (1 + (h != op3._BLANK).sum() / op3.TEMPER) for h in grams])
    share = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    own = np.array([share(s) if (h != op3._BLANK).any() else 0 * s for s, h in zip(score, grams, strict=True)])
    total = own.sum(axis=0)
    base = (total + 1) / (total.sum() + len(total))
    out = []
    for i, (s, (_, source)) in enumerate(zip(score, rows, strict=True)):
        others = sum((own[j] for j, (_, x) in enumerate(rows) if x == source), 0 * total) - own[i]
        post = share(s + np.log((np.maximum(others, 0) + op3.STRENGTH * base) / (np.maximum(others, 0).sum() + op3.STRENGTH)))
        out.append(([*names, "und"][int(post.argmax())], float(post.max())) if own[i].any() else ("und", 1.0))
    return out


def test_every_label_has_a_model_as_in_a_plain_loop(spark):
    import random

    r = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    own = [["".join(r.choice(alphabet) for _ in range(3)) for _ in range(8)] for _ in range(60)]
    word = lambda k: "".join(r.choice(own[k]) for _ in range(r.randint(1, 3)))
    texts = [" ".join(word(i % 60) for _ in range(30)) for i in range(240)] + ["12 34", "abc"]
    langs = [f"l{i % 60:02d}" if i % 4 else None for i in range(240)] + [None, None]
    df = docs(spark, texts).withColumn("at", F.col("doc_id")).drop("lang")
    df = df.join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    got = {x.doc_id: x for x in op3.identify(df, spark.createDataFrame([], "page_id long, url string, html string")).collect()}
    want = plain_posteriors([(t, f"s{i % 3}") for i, t in enumerate(texts)], langs)
    for i, (language, confidence) in enumerate(want):
        assert got[i].language == language and abs(got[i].confidence - confidence) < 1e-3, i
    assert len({got[i].language for i in range(240)}) >= 55
