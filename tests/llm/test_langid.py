from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest

from stratakit.llm import common, langid as L


def slow(rows):
    """Predictions by plain dictionaries: (doc_id, text, lang) to (lang, share)."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    train = [(t, lang) for i, t, lang in rows if not fold(i) and t is not None and lang is not None]
    langs = sorted({lang for _, lang in train})
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for text, lang in train:
        words[lang].update(L.words_of(text))
    for lang, held in words.items():
        for w in held:
            grams[lang].update(g for n in range(1, 6) for g in L.grams_of(w, n))
    kinds, total = len({w for c in words.values() for w in c}), {x: sum(words[x].values()) for x in langs}
    gram_kinds = Counter(len(g) for g in {g for c in grams.values() for g in c})
    gram_total = {(x, n): sum(v for g, v in grams[x].items() if len(g) == n) for x in langs for n in range(1, 6)}

    def score(word, x):
        if any(word in words[y] for y in langs):
            return math.log((words[x][word] + 0.5) / (total[x] + 0.5 * (kinds + 1)))
        for n in range(5, 0, -1):
            known = [g for g in L.grams_of(word, n) if any(g in grams[y] for y in langs)]
            if known:
                return sum(math.log((grams[x][g] + 0.5) / (gram_total[x, n] + 0.5 * (gram_kinds[n] + 1))) for g in known) / len(known)
        return 0.0

    out = []
    for i, text, _ in rows:
        if not langs or not any(map(str.isalpha, text or "")):
            out.append((i, fold(i), "und", 0.0))
            continue
        sums = [math.log((total[x] + 0.5) / (sum(total.values()) + 0.5 * len(langs))) + sum(score(w, x) * n for w, n in Counter(L.words_of(text)).items()) for x in langs]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        out.append((i, fold(i), langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-6)


@pytest.mark.parametrize("head", [40, 100_000])
def test_query_equals_brute_force(spark, monkeypatch, head):
    """Whatever workers hold, words and n-grams come from all training texts."""
    monkeypatch.setattr(L, "HEAD", head)
    rows = [(r.doc_id, r.text, r.lang) for r in common.documents(spark, "/root/testdata/sf0.001").collect()]
    same(L.op10_language(spark, "/root/testdata/sf0.001").collect(), slow(rows))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in common.documents(spark, "/root/testdata/sf0.01").collect()}
    got = L.op10_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    own = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in own) >= 0.97 * len(own)


def test_unseen_and_long_words_ties_and_odd_rows(spark, odd_docs, no_docs, as_tables, monkeypatch, tmp_path):
    monkeypatch.setattr(L, "HEAD", 3)
    monkeypatch.setattr(L, "HELD", 2)
    extra = [(101, "walking talking running " + "long" * 40, "en"), (102, "gehen laufen sprechen", "de"), (103, "jumping singing", None), (105, "日本", "de"), (106, "123 ²", "en"), (107, "long" * 40, None)]
    docs = odd_docs.unionByName(spark.createDataFrame([(i, t, x, None, 0) for i, t, x in extra], "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    same(L.op10_language(spark, as_tables(documents=docs)).collect(), slow(rows))
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert L.op10_language(spark, f"{tmp_path}/none").count() == 0
