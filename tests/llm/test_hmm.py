from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from stratakit.llm import common, hmm as H


def random_model(states, classes, seed=0):
    draw = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return H.Model(norm(draw.random(states), 0), norm(draw.random((states, states)), 1), norm(draw.random((classes, states)), 0))


def slow_likelihood(model, ids):
    """The sum over all paths of states."""
    total = 0.0
    for path in itertools.product(range(len(model.first)), repeat=len(ids)):
        p = model.first[path[0]]
        for t, s in enumerate(path):
            p *= model.emits[ids[t], s] * (model.moves[path[t - 1], s] if t else 1)
        total += p
    return total


def slow_counts(model, ids):
    first, moves, emits = np.zeros(len(model.first)), np.zeros_like(model.moves), np.zeros_like(model.emits)
    whole = slow_likelihood(model, ids)
    for path in itertools.product(range(len(model.first)), repeat=len(ids)):
        p = model.first[path[0]]
        for t, s in enumerate(path):
            p *= model.emits[ids[t], s] * (model.moves[path[t - 1], s] if t else 1)
        p /= whole
        first[path[0]] += p
        for t, s in enumerate(path):
            emits[ids[t], s] += p
            if t:
                moves[path[t - 1], s] += p
    return first, moves, emits


@pytest.mark.parametrize("steps", [2, 3, 100])
def test_forward_and_counts_equal_all_paths(monkeypatch, steps):
    """Also where texts are taken in blocks of steps."""
    monkeypatch.setattr(H, "HELD_STEPS", steps)
    model, draw = random_model(2, 5), np.random.default_rng(1)
    texts = [draw.integers(0, 5, n).astype(np.uint16) for n in (1, 7, 3, 6, 1, 4)]
    assert np.allclose(H.log_likelihoods(model, texts), [np.log10(slow_likelihood(model, t)) for t in texts])
    found = H.Expected(2, 5)
    found.add(model, texts)
    want = [sum(x) for x in zip(*(slow_counts(model, t) for t in texts))]
    assert np.allclose(found.first, want[0]) and np.allclose(found.emits, want[2])
    assert np.allclose(found.moves * model.moves, want[1])


@pytest.mark.parametrize("cells", [4, 24, 400_000])
def test_counts_of_whole_texts_equal_plain_ones(monkeypatch, cells):
    """Also where texts are taken one by one or a few at a time."""
    monkeypatch.setattr(H, "CELLS", cells)
    model, draw = random_model(3, 5), np.random.default_rng(1)
    texts = [draw.integers(0, 5, n).astype(np.uint16) for n in (1, 7, 3, 6, 1, 4)]
    first, emits = np.zeros(3), np.zeros((5, 3))
    for text in texts:
        p = model.first * np.prod(model.emits[text], axis=0)
        first += p / p.sum()
        for c in text:
            emits[c] += p / p.sum()
    found = H.Expected(3, 5)
    found.add_whole(model, texts)
    assert np.allclose(found.first, first) and np.allclose(found.emits, emits) and not found.moves.any()


def test_the_start_counts_every_training_text(spark):
    """Before, texts of over 4,096 tokens and all beyond 400,000 tokens had no part in the start."""
    counts = spark.createDataFrame([(w, 5000) for w in "abc"] + [("", 10)], "word string, n long")
    words = H.vocabulary(common.written(counts, "lm-words"))
    texts = [np.array([1, 2] * 20 + [0], np.uint16), np.array([3] * 5000 + [0], np.uint16)]
    rows = [common.written(spark.createDataFrame([(i, bytearray(t.tobytes()), len(t)) for i, t in enumerate(own)], "doc_id long, ids binary, n_tokens long"), "lm-classes") for own in (texts, texts[:1])]
    both, one = (H.train(r, words, states=2, rounds=0) for r in rows)
    assert not np.allclose(both.first, one.first)


def test_query_equals_brute_force_and_beats_the_base(spark):
    docs = common.documents(spark, "/root/testdata/sf0.01").collect()
    tokens = {r.doc_id: H.tokens_of((r.text or "").encode()) for r in docs}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in H.op2_hmm(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == tokens.keys()
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(ws), n)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    own = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_one_state_is_the_smoothed_unigram_model(spark):
    """Then all probabilities of a next token, one unseen word in each shared class among them, sum to 1."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b b c", "a a d", "b e"] * 4)], "doc_id bigint, text string")
    train = [t for i, t in enumerate(["a b b c", "a a d", "b e"] * 4) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in H.tokens_of(t.encode()))
    got = H.score(docs, states=1, rounds=1).collect()
    whole = sum(counts.values()) + len(counts) + H.TAIL
    for r, text in zip(sorted(got, key=lambda r: r.doc_id), ["a b b c", "a a d", "b e"] * 4):
        assert r.score == pytest.approx(sum(np.log10((counts[w] + 1) / whole) for w in H.tokens_of(text.encode())), rel=1e-6)


def test_small_head_shares_classes(spark, monkeypatch):
    monkeypatch.setattr(H, "HEAD", 3)
    monkeypatch.setattr(H, "TAIL", 2)
    monkeypatch.setattr(H, "HELD_WORDS", 2)
    docs = spark.createDataFrame([(i, f"a a b w{i % 5} A") for i in range(30)] + [(99, "unseen words")], "doc_id bigint, text string")
    counts = Counter(w for i in [*range(30), 99] if zlib.crc32(str(i).encode()) % 7 != 2 for w in H.tokens_of((f"a a b w{i % 5} A" if i < 99 else "unseen words").encode()))
    n, v = sum(counts.values()), len(counts)
    for r in H.score(docs).collect():
        words = H.tokens_of((f"a a b w{r.doc_id % 5} A" if r.doc_id < 99 else "unseen words").encode())
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.n_known == sum(counts[w] > 0 for w in words) and np.isfinite(r.score)


def test_odd_rows(spark, odd_docs, no_docs):
    got = H.score(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(np.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert H.score(no_docs).count() == 0
    alone = spark.createDataFrame([(i, "never trained") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in H.score(alone).collect())
