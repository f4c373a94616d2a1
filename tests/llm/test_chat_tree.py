"""Operator 1: round trip, order, sharing, positions and attention of the tree."""

import hashlib
import random
import time

import public_tokenizers
import pytest
from helpers import prose

from changelens.llm import op1_chat_tree as op1

PATH = public_tokenizers.path("byte_bpe_50k.json")
MARKS = "<|im_end|><|im_start|>assistant ok"
SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    r = random.Random(4)
    rows, heads = [], [[("system", prose(20, i)), ("user", prose(10, 10 + i))] for i in range(3)]
    for c in range(60):
        turns = list(heads[0 if c % 3 == 0 else r.randrange(3)][: r.randint(0, 2)])
        for k in range(r.randint(0, 4)):
            turns.append((("user", "assistant")[k % 2], prose(r.randint(0, 3), r.randrange(6))))
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    odd = [MARKS, "<\\|x", "<\\\\|", "<|", "\\", "a\nb\r\n", "", None, "é漢🙂<|endoftext|>", " lead ", "\x00\x1b"]
    for k, t in enumerate(odd):
        rows += [(100, k, "assistant", t), (101, k, ["user\n", "as\\n<|", None, ""][k % 4], t), (102 + k, 0, "assistant", t)]
    return rows + [(150, 1, "user", "tie"), (150, 1, "user", "tie"), (150, 1, "assistant", "tie"), (150, None, "user", "early"), (None, 0, "user", "no id"), (151, 5, "assistant", prose(5000, 1))]


def plain(rows):
    convs = {}
    for c, k, role, text in rows:
        convs.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        form = "".join(f"<|im_start|>{op1.escape_role(r)}\n{op1.escape(t)}<|im_end|>\n" for r, t in turns)
        assert form.count("<|") == 2 * len(turns)
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(form)))
    return sorted(out, key=repr), {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def above(nodes, n):
    out = []
    while n.parent is not None:
        n = nodes[n.parent]
        out.append(n)
    return out[::-1]


def test_deep_conversations(spark, tmp_path):
    long = [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(20_000)]
    branch = [(2, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(10_000)] + [(2, 10_000, "user", "other")]
    rows = long + branch + [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "b")]
    start = time.time()
    op1.build(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/deep", PATH)
    got = sorted(map(tuple, op1.digests(op1.read_conversations(spark, f"{tmp_path}/deep", PATH)).collect()), key=repr)
    assert time.time() - start < 60
    assert [x[:2] for x in got] == [(1, 20_000), (2, 10_001), (None, 1), (None, 1), (None, 1)]
    assert got[:2] == plain(long + branch)[0]
    nodes = spark.read.parquet(f"{tmp_path}/deep/nodes")
    assert nodes.count() == 20_000 + 1 + 2 and nodes.selectExpr("max(size(attention))").first()[0] <= 2


@pytest.mark.parametrize("parts", [1, 7])
def test_tree(spark, tmp_path, parts):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS start", "'k' AS key", "2 AS depth").repartition(3)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    op1.build(df, f"{tmp_path}/t", PATH)
    spark.conf.set("spark.sql.shuffle.partitions", held)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    want, convs = plain(rows)
    assert sorted(map(tuple, op1.digests(op1.read_conversations(spark, f"{tmp_path}/t", PATH)).collect()), key=repr) == want

    nodes = {n.start: n for n in op1.position_ids(spark.read.parquet(f"{tmp_path}/t/nodes")).collect()}
    at = 0
    for s in sorted(nodes):  # every place is used once, without a gap
        assert s == at
        at += nodes[s].n_tokens
    assert len(nodes) == len({tuple(t[: k + 1]) for t in convs.values() for k in range(len(t))})  # shared turns once
    for n in nodes.values():
        own = above(nodes, n)
        assert [a.no for a in own] == [i for x in n.attention for i in range(x.first, x.last)]
        assert [a.depth for a in own] == list(range(n.depth)) and all(a.start < n.start for a in own)
        assert n.position == sum(a.n_tokens for a in own) and n.position_ids == list(range(n.position, n.position + n.n_tokens)) and len(n.tokens) == n.n_tokens
        places = [p for a in own for p in range(a.start, a.start + a.n_tokens)]
        assert [p for i in n.attention for p in range(i.start, i.end)] == places
        assert all(x.end < y.start for x, y in zip(n.attention, n.attention[1:]))
        assert n.tree == (own[0].start if own else n.start)
        below = [m for m in nodes.values() if n in above(nodes, m)]
        assert not below or max(m.start for m in below) + 0 < min([m.start for m in nodes.values() if m.start > n.start and n not in above(nodes, m)], default=at)  # depth-first


def test_empty(spark, tmp_path):
    op1.build(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e", PATH)
    assert op1.read_conversations(spark, f"{tmp_path}/e", PATH).count() == 0
