from __future__ import annotations

import pytest

from stratakit.llm import common, decontaminate as D
from tests.llm.conftest import prose


def slow_matches(docs, items):
    """Every item against every document: does any passage as wide as two halves pass the overlap check?"""
    half = max([D.HALF_WORDS, *(len(D.words_of(t)) for _, t in items)])
    out = set()
    for doc_id, text in docs:
        words = D.words_of(text)
        for item_id, item in items:
            parts = [D.Part(D.words_of(x)) for x in D.question_and_answer(item or "")]
            if D.words_of(item) and any(all(p.overlap({}, words[a : a + 2 * half]) >= D.OVERLAP for p in parts) for a in range(0, len(words), half)):
                out.add((doc_id, item_id))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in common.documents(spark, "/root/testdata/sf0.001").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in D.op6_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    assert got == slow_matches(docs, items)
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= got


@pytest.mark.parametrize(("index_words", "block"), [(100_000, 16), (30, 2)])
def test_near_copies_in_and_clean_out(spark, monkeypatch, index_words, block):
    monkeypatch.setattr(D, "INDEX_WORDS", index_words)
    monkeypatch.setattr(D, "BLOCK_ITEMS", block)
    items = [(i, f"{prose(30 + 3 * i, 100 + i)}? {prose(12, 200 + i)}.") for i in range(6)] + [(6, ""), (7, None), (8, "Zebra quagga okapi")]
    words = items[2][1].split()
    changed = " ".join([*words[:10], "other", *words[11:]])
    question = items[3][1].split("?")[0]
    docs = [(1, f"{prose(200, 1)} {items[0][1].upper()} {prose(90, 2)}"), (2, prose(50, 5) + "\n" + changed), (3, f"{prose(40, 8)} {question} {prose(60, 9)}"), (4, prose(300, 7)), (5, None), (None, items[5][1]), (6, "the zebra, QUAGGA okapi!"), (7, "okapi zebra quagga"), (6, "zebra quagga okapi")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS score")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()}
    assert found == slow_matches(docs, [x for x in items])
    assert found == {(1, 0), (2, 2), (None, 5), (6, 8)}
    kept = D.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert D.matches(docs, bench).count() == 0 and D.clean(docs, bench).count() == 1
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert D.clean(no_docs, bench).count() == 0 and D.matches(docs, bench).count() == 1


def test_question_and_answer():
    assert D.question_and_answer("Who is it? A fox.") == ("Who is it?", " A fox.")
    assert D.question_and_answer("One two. Three four.") == ("One two.", " Three four.")
    assert D.question_and_answer("No end") == ("No end", "")


@pytest.mark.parametrize("index_words", [100_000, 200, 30])
def test_passages_do_not_depend_on_the_dealing(spark, monkeypatch, index_words):
    """Question and answer with other text between them are found beside longer items, whatever index they are in."""
    monkeypatch.setattr(D, "INDEX_WORDS", index_words)
    items = [(i, f"{prose(12, 100 + i)}? {prose(8, 200 + i)}.") for i in range(4)] + [(9, f"{prose(50, 300)}? {prose(12, 301)}.")]
    question, answer = items[1][1].split("?")
    docs = [(i, f"{prose(at, 5)} {question}? {prose(30, 6)} {answer} {prose(150, 7)}") for i, at in enumerate((0, 5, 10))] + [(7, f"{prose(90, 8)} {items[9 - 5][1]}"), (8, prose(200, 9))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()} == {(0, 1), (1, 1), (2, 1), (7, 9)}
    assert [r.doc_id for r in D.clean(frame, bench).collect()] == [8]


def test_odd_and_long_rows(spark, odd_docs, as_tables):
    long = max((r for r in odd_docs.collect()), key=lambda r: len(r.text or ""))
    bench = spark.createDataFrame([(1, f"{' '.join(long.text.split()[20_000:20_040])}? {' '.join(long.text.split()[20_040:20_050])}."), (2, None)], "item_id bigint, text string")
    folder = as_tables(documents=odd_docs, benchmark=bench)
    assert [(r.doc_id, r.item_id) for r in D.op6_decontaminate(spark, folder).collect()] == [(long.doc_id, 1)]
    kept = D.stage(spark, odd_docs, folder)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1


def test_retrieval_equals_scoring_every_item():
    """Pivots and skipped blocks lose no item that reaches its threshold."""
    import random

    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(3, 12)))) for i in range(80)]
    for block in (1, 3, 16):
        index = D.Index(items, 64, block)
        for _ in range(60):
            terms = sorted(index.vocabulary[w] for w in set(draw.choices(words, k=draw.randrange(2, 40))) if w in index.vocabulary)
            scores = dict.fromkeys(range(len(index.ids)), 0.0)
            for t in terms:
                for i, v in zip(*index.postings(t)[:2], strict=True):
                    scores[i] += v
            want = {i: v for i, v in scores.items() if v >= D.NEAR_ONE}
            assert dict(index.retrieve(terms)) == pytest.approx(want)
