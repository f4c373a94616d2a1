"""Operators 4, 5 and 10 against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import TEXTS, awkward, docs

from changelens.llm import op4_token_files as op4
from changelens.llm import op5_token_counts as op5
from changelens.llm import op10_quality as op10

PATH = public_tokenizers.path("word_bpe_49k.json")


def key(rows):
    return sorted(rows, key=repr)


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    hit = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("change", [lambda d: d, awkward])
def test_ledger(spark, change):
    df = change(docs(spark))
    got = op10.apply_policy(op10.ledger(df), "base").selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept").collect()
    want = []
    for r in df.select("doc_id", "text").collect():
        m = measured(r.text)
        want.append((r.doc_id, *m, not (m[0] < 10 or 100 * m[4] > 20 * m[0])))
    assert key(map(tuple, got)) == key(want)


def test_repeated_words_beyond_64_bits():
    words = [str(i) for i in range(7000)] + ["5", "6", "7", "8", "9", "x", "5", "6", "7", "8", "9"]
    assert op10.repeated_words(words) == 15


def test_ablation_and_empty(spark):
    found = op10.ledger(docs(spark)).cache()
    rows = found.collect()
    for policy in op10.POLICIES:
        bits = [r.bits & op10.mask(policy) for r in rows]
        got = {r.rule: (r.n_failed, r.n_only) for r in op10.ablation(found, policy).collect()}
        for i, (name, _) in enumerate(op10.RULES):
            if name in op10.POLICIES[policy]:
                assert got[name] == (sum(b >> i & 1 for b in bits), bits.count(1 << i))
    assert op10.ledger(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("change", [lambda d: d, awkward])
@pytest.mark.parametrize("known", [3, 200_000])
def test_token_counts(spark, tokenizer, change, known):
    df = change(docs(spark))
    got = op5.count_tokens(df, PATH, 50, known).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 50) for r in df.select("doc_id", "text").collect()]
    assert key(map(tuple, got)) == key(want)
    assert op5.count_tokens(df.limit(0), PATH).count() == 0


def test_sequence_files(spark, tokenizer, tmp_path):
    df = docs(spark).repartition(3)
    out = f"file://{tmp_path}/seqs"
    index = op4.write_sequences(df, out, PATH, seq_len=64)
    got = {r.doc_id: r for r in op4.read_documents(index, out).collect()}
    at = 0
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    reader = op4.Reader(out)
    shard = got[10].shard
    attempt = index.filter(f"shard = {shard}").first().attempt
    ids, mask = reader.sequence(shard, attempt, 1)
    assert len(ids) == 64 and ids.base is not None and mask.to_pylist() == [True] * 64
    total = sum(r.n_tokens for r in got.values() if r.shard == shard)
    ids, mask = reader.sequence(shard, attempt, total // 64)
    assert mask.to_pylist() == [i < total % 64 for i in range(64)]


def test_sequence_files_awkward(spark, tokenizer, tmp_path):
    df = awkward(docs(spark))
    index = op4.write_sequences(df, f"{tmp_path}/a", PATH, seq_len=128)
    got = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in op4.read_documents(index, f"{tmp_path}/a").collect()]
    want = [(r.doc_id, len(i := [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(i, "<u4").tobytes())) for r in df.select("doc_id", "text").collect()]
    assert key(got) == key(want)
    empty = op4.write_sequences(df.limit(0), f"{tmp_path}/b", PATH)
    assert op4.read_documents(empty, f"{tmp_path}/b").count() == 0


def test_the_memo_of_a_task_process_stays_small():
    import tracemalloc

    from changelens.llm.pretokens import Memo

    class Plain:
        def encode(self, found):
            return [[len(c), int(c[1:]) % 251] for c in found]

    tracemalloc.start()
    held = Memo(Plain())
    for at in range(0, 600_000, 20_000):  # chunks that stand in one text only, and a common one
        found = held.ids([b" ".join(b"x%d" % i for i in range(at, at + 20_000)) + b" x7", b"x7 x8"])
        assert found[0].tolist()[:2] == [len(f"x{at}"), at % 251] and found[0].tolist()[-2:] == [2, 7]
        assert found[1].tolist() == [2, 7, 2, 8]
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 40 << 20


def test_the_memo_keeps_what_many_texts_hold():
    from changelens.llm.pretokens import Memo

    class Plain:
        def __init__(self):
            self.seen = Counter()

        def encode(self, found):
            self.seen.update(found)
            return [[len(c), int(c[1:]) % 251] for c in found]

    plain = Plain()
    held = Memo(plain, 1000)
    common = [b"c%d" % i for i in range(300)]
    for at in range(0, 20_000, 100):
        rare = [b"x%d" % i for i in range(at, at + 100)]
        found = held.ids([b" ".join(common + rare), b"", b"c7"])
        assert found[0].reshape(-1, 2).tolist() == [[len(c), int(c[1:]) % 251] for c in common + rare]
        assert found[1].tolist() == [] and found[2].tolist() == [2, 7]
        assert len(held.place) <= 1000 + 400
    assert {plain.seen[c] for c in common} == {1}


def test_chunks_encode_as_the_library_does(tokenizer):
    from changelens.llm.pretokens import Encoder, Memo

    chunks = "the naïve É Éç straße ÿ ÷ a÷b ×é a×b ét́e é́ the!!! été$$$ don't don' d's 's é's x'' a. a.b KK ŝ İx ﬁ ж жук! 日本 ½ ²a a² 12 a1 a_b a_ é_ <| a<|endoftext|> <|endoftext|> <|startoftext|>é É<|endoftext|>! Abc ABC!"
    found = [c.encode() for c in chunks.split(" ")]
    encoder = Encoder(PATH)
    want = [tokenizer.encode(c.decode(), add_special_tokens=False).ids for c in found]
    assert encoder.encode(found) == want and encoder.encode([]) == []
    texts = [chunks, chunks.replace("<|", "< |"), chunks.upper(), ""]
    assert [i.tolist() for i in Memo(encoder).ids([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    texts, encoder._texts = encoder._texts, lambda found: texts(found) if {*found} <= {b"!", b"$$"} else pytest.fail(f"{found} by the whole library")
    assert encoder.encode([c.encode() for c in "été straße! Ça$$ the!".split()]) == [tokenizer.encode(c, add_special_tokens=False).ids for c in "été straße! Ça$$ the!".split()]
