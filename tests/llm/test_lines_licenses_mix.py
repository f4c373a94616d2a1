"""Operators 6, 7 and 8 against plain loops, and every query with SQL against it."""

import random
import re
from collections import Counter

import oracle
import pytest
from helpers import awkward, docs, prose
from pyspark.sql import functions as F

from changelens.llm import op6_lines as op6
from changelens.llm import op7_licenses as op7
from changelens.llm import op8_mix as op8
from changelens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE[name]) is None


def line_texts():
    r = random.Random(2)
    pool = [prose(4, i) for i in range(14)] + ["", "  "]
    block = [prose(8, 100 + i) for i in range(7)]
    out = []
    for _ in range(40):
        ls = [r.choice(pool) for _ in range(r.randint(0, 8))]
        if r.random() < 0.6:
            i = r.randint(0, 3)
            ls[r.randint(0, len(ls)) :] = block[i : r.randint(i + 1, 7)]
        out.append("\n".join(ls))
    long = [prose(60, 1), prose(26, 2) + "\t" + prose(10, 3) + "  x", " " + prose(30, 4) + "\r", prose(49, 5)]
    for _ in range(20):
        out.append("\n".join(r.choice([*long, *pool[:3]]) for _ in range(r.randint(1, 3))))
    return out + [None, "", "x\nx\nx\nx\nx\nx", out[3], out[3]]


def plain_lines(rows):
    """rows: (doc_id, text) in order; every run (RUN lines, or fewer with LONG words) against all earlier ones."""
    seen, out = set(), []
    for d, t in rows:
        lines = (t or "").split("\n")
        held = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        words = [len([w for w in re.split("[ \t\r\x0b\x0c]+", lines[i]) if w]) for i in held]
        gone = set()
        for size in range(1, op6.RUN + 1):
            for s in range(len(held) - size + 1):
                if size == op6.RUN or sum(words[s : s + size]) >= op6.LONG:
                    k = tuple(lines[i] for i in held[s : s + size])
                    gone |= set(held[s : s + size]) if k in seen else set()
                    seen.add(k)
        out.append((d, t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_lines(spark):
    df = docs(spark, line_texts())
    got = op6.without_repeats(df).select("row.doc_id", "clean_text").collect()
    assert sorted(map(tuple, got)) == sorted(plain_lines([(r.doc_id, r.text) for r in df.collect()]))
    df = awkward(df)
    got = op6.without_repeats(df)
    assert got.count() == df.count() and got.select("row.*").columns == df.columns
    assert op6.without_repeats(df.limit(0)).count() == 0


def plain_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = [w for w in re.split(op7.GAP, low) if w]
    base = [(i, lab) for p, lab in op7.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    best, more = 0.0, set()
    for kind, label, t in op7.TEMPLATES:
        own = set(op7.words(t))
        pars = re.split(op7._BLANK_LINE, low)
        windows = [" ".join(ls[i : i + op7.LINES]) for ls in (p.split("\n") for p in pars) for i in range(max(1, len(ls) - op7.LINES + 1))]
        for b in windows if kind == "line" else pars:
            n = len(own & {w for w in re.split(op7.GAP, b) if w})
            if n >= op7._need(len(own), op7.THRESHOLD):
                more.add(label)
                best = max(best, n / len(own))
    at = [i for i, _ in base]
    labels = {x for _, x in base}
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if at else best


def license_texts():
    r = random.Random(7)
    out = [None, "", "CC-BY cc by CC by by cc\nAll\nRights   reserved; general public license", "all rights reserved " * 3, "é,cc by x ccé by"]
    for _, _, t in op7.TEMPLATES:
        ws = t.split()
        for drop in (0, 1, 2, 4, 8):
            keep = [w for i, w in enumerate(ws) if i not in r.sample(range(len(ws)), min(drop, len(ws)))]
            out += [prose(20, drop) + "\n" + " ".join(keep) + ".\nof the\n", "\n\n".join([prose(10, 1), "\n".join(keep), prose(5, 2)]), " ".join(reversed(keep))]
    return out


def test_wrapped_statements_are_found(spark):
    text = "/* " + next(t for _, lab, t in op7.TEMPLATES if lab == "mpl-2.0").replace("Mozilla Public", "Mozilla Public\n *") + " */"
    far = text.replace("\n", "\n\n")
    got = {r.doc_id: (r.labels, r.score) for r in op7.scan(docs(spark, [text, far, "a\n" + text + "\nb"])).collect()}
    assert got[0] == got[2] == ("mpl-2.0", 1.0) and got[1][1] < 1.0


def test_licenses(spark):
    for df in (docs(spark, license_texts()), awkward(docs(spark, license_texts())), awkward(docs(spark))):
        got = [tuple(r) for r in op7.scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()]
        assert sorted(got, key=repr) == sorted(((r.doc_id, *plain_scan(r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
    assert op7.scan(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 5.0, "b": 1.0, "c": 0.01}, {f"s{i}": float(1 + i % 7) for i in range(30)}, {"x": 1.0},
                                     {**{f"s{i}": 1.0 for i in range(499)}, "big": 16.0}, {f"s{i}": 1.0 + (i == 7) * 300 for i in range(2000)}])
def test_schedule_is_pfair(spark, weights):
    n = 8 if len(weights) < 400 else 2
    total = sum(weights.values())
    parts = op8.shares(spark.createDataFrame(list(weights.items()), "src string, weight double"))
    sizes = {s: int(n * max(1, w / min(weights.values()) / 30)) for s, w in weights.items()}
    plan = sorted((r.slot, r.src, r.release, r.deadline, r.block) for r in op8.schedule(parts.join(spark.createDataFrame(list(sizes.items()), "src string, n long"), "src")).collect())
    assert len({t for t, *_ in plan}) == len(plan) == sum(sizes.values())
    assert all(release <= t < due for t, _, release, due, _ in plan)
    ends = {s: (k - 1) * total / weights[s] for s, k in sizes.items()}  # until then a source has blocks left
    at = {s: [t for t, x, *_ in plan if x == s] for s in list(weights)[:5] + list(weights)[-5:]}
    for s, slots in at.items():  # against the target weight, in every slot
        for i, t in enumerate(slots):
            if t < ends[s]:
                assert abs(i + 1 - weights[s] / total * (t + 1)) < 1 and abs(i - weights[s] / total * t) < 1


def test_mix(spark):
    r = random.Random(3)
    texts = [prose(r.randint(0, 60), i) for i in range(400)] + [None, ""]
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, "none").otherwise(F.col("source")))
    targets = spark.createDataFrame([("hot", 0.5), ("s1", 0.3), (None, 0.2), ("none", 0.0), ("absent", 0.1)], "source string, weight double")
    got = op8.mixed(df, targets, block_chars=500).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(texts)))
    for x in got:
        assert (x.slot is None) == (x.source in ("none", "s2", "s0"))
        if x.slot is not None:
            assert x.release <= x.slot < x.deadline and x.block == x.offset // 500
    taken = {}
    for x in got:
        if x.slot is not None:
            assert taken.setdefault(x.slot, (x.source, x.block)) == (x.source, x.block)
    for n in (50, 500):
        rows = awkward(df)
        out = op8.in_mix_order(rows, targets, block_chars=n)
        assert out.columns == rows.columns and out.count() == rows.count()
    assert op8.mixed(df.limit(0)).count() == 0
    assert op8.in_mix_order(df.limit(0)).count() == 0


def test_written_order(spark, tmp_path):
    df = docs(spark, [prose(30, i) for i in range(200)])
    op8.in_mix_order(df, block_chars=300).write.parquet(f"{tmp_path}/m")
    at = {x.doc_id: (x.slot, x.offset) for x in op8.mixed(df, block_chars=300).collect()}
    rows = spark.read.parquet(f"{tmp_path}/m").select("doc_id", "_metadata.file_name", F.col("_metadata.row_index").alias("i")).orderBy("file_name", "i").collect()
    got = [at[x.doc_id] for x in rows]
    assert [s for s, _ in got] == sorted(s for s, _ in got)


def test_places_do_not_depend_on_the_cells(spark, monkeypatch):
    df = docs(spark, [prose(20, i) for i in range(150)])
    want = sorted(map(tuple, op8.mixed(df, block_chars=300).collect()))
    monkeypatch.setattr(op8, "CELL_ROWS", 4)
    assert sorted(map(tuple, op8.mixed(df, block_chars=300).collect())) == want
