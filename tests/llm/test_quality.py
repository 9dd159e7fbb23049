from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from stratakit.llm import common, quality
from tests.llm.conftest import DOC_SCHEMA, prose

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def slow_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(common.WORD_PATTERN, text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(common.WORD_PATTERN, line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check_counts(docs, got):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        counts = slow_counts(r.text)
        want[(r.doc_id, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])] += 1
    assert Counter((r.doc_id, *(r[c] for c in COUNTS), r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_counts_equal_brute_force(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001")
    got = quality.op4_quality(spark, "/root/testdata/sf0.001").collect()
    check_counts(docs, got)
    assert any(r.kept for r in got) and any(r.base_failed for r in got)


def test_odd_rows(spark, odd_docs, no_docs, as_tables):
    check_counts(odd_docs, quality.op4_quality(spark, as_tables(documents=odd_docs)).collect())
    kept = quality.stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} <= {1, 2, 5, 9, 10, None}
    assert quality.stage(spark, no_docs, "").count() == 0


def test_many_repeated_windows(spark):
    """More repeated windows than are looked up one by one."""
    text = " ".join([prose(60, 5), prose(300, 6), prose(60, 5), "a a a a a", prose(60, 5)])
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], DOC_SCHEMA)
    (r,) = quality.judge(docs, ["doc_id"]).collect()
    assert tuple(r[c] for c in COUNTS) == slow_counts(text)


def test_outliers_go_and_clean_documents_stay(spark):
    clean = [(i, prose(80 + i % 40, i), "en", "s", 0) for i in range(240)]
    loud = [(1000 + i, " ".join(w if k % 3 else "#$%&" for k, w in enumerate(prose(90, 500 + i).split())), "en", "s", 0) for i in range(40)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(clean + loud, DOC_SCHEMA), ["doc_id"]).filter("kept").collect()}
    assert not any(i >= 1000 for i in kept)
    assert len(kept) >= 0.98 * len(clean)


def test_small_cells_reject_nothing(spark):
    docs = [(i, prose(80, i), "en", f"s{i}", 0) for i in range(20)] + [(99, "#$%& " * 3 + prose(80, 77), "en", "s99", 0)]
    assert quality.judge(spark.createDataFrame(docs, DOC_SCHEMA), ["doc_id"]).filter("kept").count() == 21


def test_estimate_equals_numpy(spark):
    """Mean and inverse Cholesky factor of the covariance, from the sums."""
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(80, quality.P)) @ draw.normal(size=(quality.P, quality.P))
    frame = spark.createDataFrame([("c", *map(float, r)) for r in rows], ["cell", *quality.NAMES])
    got = quality._estimate(quality._moments(frame, ["cell"]), ["cell"]).first()
    floors = np.diag([x * x for x in quality.FLOORS.values()])
    cov = quality.consistency(quality.P, quality.SUPPORT) * np.cov(rows.T, bias=True) + floors
    want = np.linalg.inv(np.linalg.cholesky(cov))
    assert got.m == pytest.approx(rows.mean(axis=0).tolist())
    assert got.w == pytest.approx([want[i, j] for i, j in quality.LOWER_PAIRS])
    assert got.log_det == pytest.approx(np.linalg.slogdet(cov)[1])


def test_fit_resists_a_fifth_of_outliers(spark):
    draw = np.random.default_rng(2)
    near, far = draw.normal(size=(320, quality.P)), draw.normal(size=(80, quality.P)) * 0.1 + 12
    rows = np.concatenate([near, far])
    frame = spark.createDataFrame([("c", *map(float, r)) for r in rows], ["cell", *quality.NAMES])
    (got,) = quality.fit(frame).collect()
    assert np.abs(got.m).max() < 0.3
    w = np.zeros((quality.P, quality.P))
    for (i, j), v in zip(quality.LOWER_PAIRS, got.w, strict=True):
        w[i, j] = v
    d2 = (((rows - np.array(got.m)) @ w.T) ** 2).sum(axis=1)
    cut = quality.chi_square(quality.P, quality.TAIL)
    assert (d2[320:] > cut).all() and (d2[:320] > cut).mean() < 0.02


def test_chi_square_quantile():
    assert quality.chi_square(2, 0.05) == pytest.approx(5.991, abs=1e-3)
    assert quality.chi_square(6, 0.01) == pytest.approx(16.812, abs=1e-3)
