"""The pipeline against a loop over its stages."""

import zlib

import corpus_pipeline
import numpy as np
from helpers import awkward
from test_near_copies import plain_kept
from test_simhash_and_tiling import plain_coverage

from changelens.llm import op2_decontaminate as op2
from changelens.llm import op3_language as op3
from changelens.llm import op8_mix as op8

SF = "/root/testdata/sf0.001"


def test_run(spark, tokenizer):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r for r in op3.keep_known(table).collect()}
    assert len(docs) > 0.9 * table.count()
    firsts, kept = plain_kept([(d, r.text) for d, r in docs.items()]), []
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(w[i : i + 4]) for w in [op2.words((t or "").encode())] for i in range(len(w) - 3)}
    for d in firsts:
        own = grams(docs[d].text)
        if not any(own & grams(t) and plain_coverage(t, docs[d].text) >= op2.COVERAGE * len(op2.words(t.encode())) for t in items):
            kept.append(d)
    assert 0 < len(kept) < len(firsts) < len(docs)
    left = spark.createDataFrame([docs[d] for d in kept], table.schema)
    slots = {r.doc_id: (r.slot is None, r.slot, r.source, r.offset) for r in op8.mixed(left).collect()}
    want, at = [], 0
    for d in sorted(kept, key=lambda d: (*slots[d], d)):
        ids = [*tokenizer.encode(docs[d].text or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == want


def test_stages_keep_columns(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for change in (lambda d: d, awkward, lambda d: d.limit(0)):
        docs = change(table)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                path = f"{tmp_path}/{id(change)}-{i}"
                out.write.mode("overwrite").parquet(path)
                docs = spark.read.parquet(path)
        assert out.count() == docs.count()
    assert corpus_pipeline.as_written(spark.createDataFrame([(1, "a")], "doc_id long, text string")) is None
