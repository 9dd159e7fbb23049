from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from stratakit.llm import common, runs as R


def slow_runs(words):
    """Every period by itself: maximal stretches, those of the smallest period."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def slow(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(slow_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for a, m, p in found for i in range(a + p, a + m)}
    best = (None,) * 4
    if found:
        from fractions import Fraction

        a, m, p = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (a, m, p, 1000 * m // p)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{a},{m},{p}\n" for a, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), n)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, "/root/testdata/sf0.001").collect()]
    got = sorted(map(tuple, R.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(slow(*r) for r in rows) and any(r[1] for r in got)


@pytest.mark.parametrize("held", [1, 40, 1 << 18])
def test_drawn_words_of_few_kinds(monkeypatch, held):
    """Runs within runs, at both ends, of multiples of a period; texts searched together don't meet, leaves come in parts."""
    monkeypatch.setattr(R, "HELD_LEAVES", held)
    draw, texts = random.Random(held), []
    for _ in range(400):
        kinds = draw.choice((1, 2, 2, 3))
        words = [str(draw.randrange(kinds)).encode() for _ in range(draw.randrange(40))]
        for _ in range(draw.randrange(3)):
            a = draw.randrange(len(words) + 1)
            words[a:a] = (words[a : a + draw.randrange(1, 8)] * draw.randrange(1, 9))[: draw.randrange(1, 50)]
        texts.append(words)
    assert R.runs_of(texts) == [sorted(slow_runs(w), key=lambda r: (r[0], r[2])) for w in texts]


def test_long_texts_of_one_word_or_two():
    for n, unit in ((30_000, [b"a"]), (30_001, [b"a", b"b"]), (9_999, [b"x", b"x", b"y"])):
        words = (unit * n)[:n]
        assert R.runs_of([words, words]) == [[(0, n, len(unit))]] * 2 if len(unit) < 3 else R.runs_of([words])[0] == [(0, n, 3)]


def test_odd_rows_and_an_empty_table(spark, odd_docs, no_docs, as_tables, monkeypatch):
    monkeypatch.setattr(R, "HELD_WORDS", 100)
    extra = spark.createDataFrame([(30, "a " * 50), (31, "x y " * 9 + "z"), (32, "b c " * 4 + "b"), (33, "b c " * 3)], "doc_id bigint, text string")
    docs = odd_docs.filter("doc_id IS NULL OR doc_id <> 5").select("doc_id", "text").unionByName(extra).selectExpr("*", "1 AS runs", "2 AS best", "3 AS start")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, R.op11_periodic_runs(spark, as_tables(documents=docs)).collect()), key=str)
    assert got == sorted((slow(*r) for r in rows), key=str)


def test_empty_table(spark, no_docs, as_tables):
    assert R.op11_periodic_runs(spark, as_tables(documents=no_docs)).count() == 0
