"""The stages one after the other, each held against a plain version on its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stratakit.llm import common, decontaminate, mixing, quality, tokens
from tests.llm.test_nearcopies import first_ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, SF)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], SF), name))
        assert name == corpus_pipeline.STAGES[-1][0] or out[-1].columns == docs.columns
    rows = [frame.collect() for frame in out]
    ids = [[r.doc_id for r in x] for x in rows]
    assert Counter(ids[1]) == Counter(r.doc_id for r in quality.judge(docs, ["doc_id"]).filter("kept").collect())
    assert sorted(ids[2]) == first_ids([(r.doc_id, r.text) for r in rows[1]])
    leaks = {r.doc_id for r in decontaminate.matches(out[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaks)
    sizes = common.written(out[3].select("doc_id", "source", mixing.n_words(out[3]["text"]).alias("size"), "text").selectExpr("*", "doc_id AS row"), "sizes")
    targets = {r.source: r for r in mixing.targets(sizes).collect()}
    taken, most = Counter(), Counter()
    for r in rows[4]:
        taken[r.source] += len((r.text or "").split())
    for r in rows[3]:
        most[r.source] = max(most[r.source], len((r.text or "").split()))
    assert max(Counter(ids[4]).values()) <= 2 and set(ids[4]) <= set(ids[3])
    assert all(abs(taken[s] - t.target) <= most[s] + 1 for s, t in targets.items())
    # Token files: every copy, in order, with the ids that the library gives.
    tokenizer = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    want = Counter()
    for r in rows[4]:
        got = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")
        want[(r.doc_id, len(got), zlib.crc32(got.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows[5]) == want
    at = 0
    for r in sorted(rows[5], key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows[5], key=lambda r: r.start)] == sorted(ids[4])


def test_empty_table(spark, no_docs, as_tables):
    folder = as_tables(documents=no_docs, benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0
