from __future__ import annotations

import random

import pytest

from stratakit.llm import common, nearcopies, simhash


def shingles(text):
    words = (text or "").encode().translate(common.FOLD).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_ids(rows):
    """The least id of each component at a Jaccard similarity of 0.8, by comparing all."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def test_stage_equals_brute_force_jaccard(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001")
    want = first_ids([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == want


@pytest.mark.parametrize("stars", [0, 4])
def test_crowds_and_chains(spark, monkeypatch, stars):
    """Near copies drift away from the first one; a line stands in all texts; short texts and sizes on the edge of 0.8."""
    monkeypatch.setattr(nearcopies, "STARS", stars)
    draw, rows = random.Random(stars), []
    for length in (4, 5, 8, 9, 30, 60):
        for _ in range(3):
            words = [f"w{draw.randrange(5000)}" for _ in range(length)]
            for _ in range(8):
                rows.append((len(rows), " ".join([*words, "this line is the same in all of the texts"])))
                rows.append((len(rows), " ".join(words)))
                words[draw.randrange(len(words))] = f"w{draw.randrange(5000)}"
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.stage(spark, frame, "").collect()) == first_ids(rows)


def test_only_sets_in_a_pair_are_made_whole(spark, monkeypatch):
    """Texts that share a line, and so buckets, but could not be similar are not made into whole sets again."""
    made, plain = [], nearcopies.whole_sets

    def counted(*args):
        found = plain(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(nearcopies, "whole_sets", counted)
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(100_000)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, f"{t} this line is the same in all") for i, t in enumerate([*texts, f"{texts[7]} or nearly"])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.stage(spark, frame, "").collect()) == first_ids(rows) == list(range(40))
    assert sum(made) == 2
