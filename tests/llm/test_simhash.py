from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from stratakit.llm import common, graph, simhash


def slow_fingerprint(text: str | None) -> int:
    words = re.findall(common.WORD_PATTERN, (text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(marks: list[int]) -> dict[int, int]:
    parent = {m: m for m in marks}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(marks):
        for b in marks[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {m: root(m) for m in marks}


def expected(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    marks = [slow_fingerprint(t) for _, t in rows]
    root = slow_components(sorted(set(marks)))
    least: dict[int, int | None] = {}
    for (i, _), m in zip(rows, marks, strict=True):
        r = root[m]
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, f"{m:016x}", least[root[m]]) for (i, _), m in zip(rows, marks, strict=True)), key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, "/root/testdata/sf0.001").collect()]
    got = simhash.op5_simhash(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_odd_rows(spark, odd_docs, as_tables):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, simhash.op5_simhash(spark, as_tables(documents=odd_docs)).collect()), key=str) == expected(rows)


def test_stage_keeps_one_row_of_each_class(spark, odd_docs, no_docs):
    kept = simhash.stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    classes = {c for _, _, c in expected([(r.doc_id, r.text) for r in odd_docs.collect()])}
    assert len(ids) == len(set(ids)) and set(ids) == classes
    assert simhash.stage(spark, no_docs, "").count() == 0


def test_empty_table(spark, no_docs, as_tables):
    assert simhash.op5_simhash(spark, as_tables(documents=no_docs)).count() == 0


@pytest.mark.parametrize("crowd", [0, 2, 32])
def test_links_find_all_within_two_bits(spark, monkeypatch, crowd):
    """Chains and crowds of near fingerprints, whether compared in pairs or through neighbours."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw = random.Random(crowd)
    marks = set()
    for _ in range(12):
        x = draw.getrandbits(64)
        for _ in range(25):
            marks.add(x)
            for b in draw.sample(range(64), draw.choice([1, 2, 2, 3])):
                x ^= 1 << b
    signed = [int(np.uint64(m).astype(np.int64)) for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "fp bigint")
    for probes in (simhash.plan(frame), [(list(range(40)), 0), (list(range(40, 64)), 1)], [(list(range(64)), 2)]):
        found = dict(graph.components(simhash.links(frame, probes)).collect())
        want = slow_components(sorted(signed))
        assert {m: found.get(m, m) for m in signed} == want


def test_allocation_is_the_least_of_all():
    costs = [[0, 5, 9, 30], [0, 2, 3, 50], [0, 7, 8, 9]]
    cost, chosen = simhash.allocate(costs)
    every = [(costs[0][a + 1] + costs[1][b + 1] + costs[2][c + 1], [a, b, c]) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    assert cost == min(every)[0] and sum(chosen) == 0


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text.encode()) == whole == np.uint64(slow_fingerprint(text)).astype(np.int64)
