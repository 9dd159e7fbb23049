from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from stratakit.llm import common, sharding as S


def check(rows, got, shards=24):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    slots = Counter((r.shard, r.slot) for r in got)
    assert not slots or max(slots.values()) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    held = Counter()
    for r in got:
        held[r.shard] += r.size
    most = max((r.size for r in got), default=0)
    if len(got) > 20 * shards:
        assert max(abs(held[s] - sum(held.values()) / shards) for s in range(shards)) <= most


@pytest.mark.parametrize("range_rows", [2000, 10])
def test_query_shares_bytes(spark, monkeypatch, range_rows):
    monkeypatch.setattr(S, "RANGE_ROWS", range_rows)
    rows = [(r.doc_id, r.text) for r in common.documents(spark, "/root/testdata/sf0.001").collect()]
    got = S.op3_sharding(spark, "/root/testdata/sf0.001").collect()
    check(rows, got)


def test_a_third_of_rows_alike(spark, monkeypatch):
    """One record that fills a third of the table is parted by its ties."""
    monkeypatch.setattr(S, "RANGE_ROWS", 50)
    rows = [(7, "the same text")] * 400 + [(i, "x" * (i % 90)) for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = S.assign(frame, 6).collect()
    check(rows, got, 6)


def test_odd_rows(spark, odd_docs, no_docs, as_tables):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(rows, S.op3_sharding(spark, as_tables(documents=odd_docs)).collect())
    assert S.assign(no_docs).count() == 0


def test_place_breaks_ties():
    bounds = np.array([[1, 5], [3, 2], [3, 8], [9, 0]])
    keys, ties = np.array([0, 1, 1, 3, 3, 3, 4, 9]), np.array([0, 4, 5, 1, 2, 9, 0, 0])
    assert S.place(keys, ties, bounds).tolist() == [sum(tuple(b) <= (k, t) for b in bounds.tolist()) for k, t in zip(keys, ties)]
