from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from stratakit.llm import common, suffixes as S


def slow(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of rows (doc_id, text) in their order, by a set of all strings."""
    seen, out = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)):
        doc_id, text = rows[k]
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone[:-1].tolist(), strict=True) if not g)
        out[k] = (doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def strings(seed, n, kinds):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        s = [1 + draw.randrange(kinds) for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(3)):
            a = draw.randrange(len(s) + 1)
            s[a:a] = s[max(0, a - draw.randrange(20)) : a] * draw.randrange(4)
        out.append([*s, 0])
    return out


@pytest.mark.parametrize("kinds", [1, 2, 3, 50])
def test_suffix_arrays_and_prefixes(kinds):
    groups = strings(kinds, 60, kinds)
    n = np.array([len(g) for g in groups])
    text = np.array([x for g in groups for x in g])
    order = S.sorted_suffixes(text, n, np.full(len(n), kinds + 1))
    shared = S.permuted_prefixes(text, order, n)
    at = 0
    for g in groups:
        want = sorted(range(len(g)), key=lambda i: g[i:])
        assert (order[at : at + len(g)] - at).tolist() == want
        for a, b in zip(want, want[1:], strict=False):
            k = 0
            while g[a + k] == g[b + k]:
                k += 1
            assert shared[at + b] == k
        at += len(g)


def test_equal_strings_have_equal_hashes_and_lie_in_other_segments():
    draw = random.Random(4)
    text = bytes(draw.choice(b"ab") for _ in range(400)) * 2 + b"a" * 300 + bytes(draw.choice(b"abc") for _ in range(30)) * 12
    h, start, n = S.segments(text)
    assert n.sum() == len(text) - 99 and start.tolist() == (np.cumsum(n) - n).tolist() and n.max() <= S.PARTS
    where = {}
    for k, (a, m) in enumerate(zip(start.tolist(), n.tolist(), strict=True)):
        for i in range(a, a + m):
            where.setdefault(text[i : i + 100], []).append(k)
    for ks in where.values():
        assert len({int(h[k]) for k in ks}) == 1 and len(set(ks)) == len(ks)


def drawn(seed):
    """Documents of few words that share passages, with copies, edits and stretches that repeat within one."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common_ones = [prose(draw.randrange(15, 60)) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = prose(draw.randrange(60))
        for _ in range(draw.randrange(3)):
            t += " " + draw.choice(common_ones)[draw.randrange(12) :] + prose(draw.randrange(20))
        if texts and draw.random() < 0.3:
            t = draw.choice(texts)
            a = draw.randrange(len(t) + 1)
            t = t[:a] + word() + t[a + draw.randrange(5) :]
        texts.append(t)
    return [*texts, "xy" * 300, "xy" * 70, "q" * 99, "q" * 100, "q" * 101, prose(20) * 5]


@pytest.mark.parametrize(("seed", "hot"), [(1, 256), (2, 1), (3, 4)])
def test_drawn_documents(spark, as_tables, monkeypatch, seed, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "HELD_SYMBOLS", 5_000)
    rows = [(k * 37 % 71, t) for k, t in enumerate(drawn(seed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, S.op12_suffix_dedup(spark, as_tables(documents=docs)).collect()), key=str)
    assert got == slow(rows) and sum(r[2] for r in got) > 2_000


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf).collect()]
    assert sorted(map(tuple, S.op12_suffix_dedup(spark, sf).collect()), key=str) == slow(rows)


def test_odd_rows(spark, odd_docs, as_tables):
    """One file, so that rows that share an id go by their place."""
    docs = odd_docs.selectExpr("*", "1 AS row", "2 AS start", "3 AS h", "4 AS known").coalesce(1)
    sf = as_tables(documents=docs)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op12_suffix_dedup(spark, sf).collect()), key=str) == slow(rows)


def test_empty_table(spark, no_docs, as_tables):
    assert S.op12_suffix_dedup(spark, as_tables(documents=no_docs)).count() == 0


def test_crowded_groups_are_split_and_copies_stay_where_they_are(spark, as_tables, monkeypatch):
    """A crowded group makes a few rows for each different segment, not one for each string; a segment of many copies is no key of a shuffle."""
    monkeypatch.setattr(S, "HOT", 8)
    monkeypatch.setattr(S, "COPIES", 20)
    draw = random.Random(9)
    base = "".join(draw.choice("abcdefgh ") for _ in range(170))
    texts = [base] * 60
    for _ in range(60):
        a = draw.randrange(len(base))
        texts.append(base[:a] + draw.choice("XYZ") + base[a + 1 :])
    rows = list(enumerate(texts))
    wrote, real = {}, common.written

    def written(df, name, keep=False):
        out = real(df, name, keep)
        wrote.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(common, "written", written)
    sf = as_tables(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, S.op12_suffix_dedup(spark, sf).collect()), key=str) == slow(rows)
    assert wrote["crowded-groups"][0] > 0
    assert 0 < wrote["parts"][0] <= S.RANGES * wrote["shared-segments"][0]
    assert all(b <= S.RANGES * a for a, b in zip(wrote["first-parts"], wrote["parts"][1:], strict=False))
