"""Steps whose cost must follow the input: their rows, shuffles and results on small tables."""

from __future__ import annotations

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from stratakit.operators import dedupe as U
from stratakit.operators import inference as I
from stratakit.operators import knowledge as K
from stratakit.operators import search as S
from stratakit.operators import sessions as N
from stratakit.plans import registry
from tests.conftest import SF


def plan(df) -> str:
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_subtypes_are_found_without_pairs_of_a_name(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(draw.randrange(60), draw.choice("xyz"), draw.choice("abcde")) for _ in range(300)] + [(None, "x", "a"), (7, None, "a"), (8, "x", None)]
    closure = [(t, t) for t in "abcde"] + [("b", "a"), ("c", "b"), ("c", "a"), ("e", "d")]
    want: dict[int, int] = {}
    for i, k, t in rows:
        for j, k2, t2 in rows:
            if None not in (i, j, k, t, t2) and k == k2 and i != j and t != t2 and (t2, t) in closure:
                want[i] = min(want.get(i, j), j)
    written = []
    monkeypatch.setattr(K, "settled", lambda df, name="step", real=K.settled: written.append(real(df, name)) or written[-1])
    got = K.subtype_folds(spark.createDataFrame(rows, "id long, key string, type string"), spark.createDataFrame(closure, "name string, ancestor string"))
    assert {r.id: r.into for r in got.collect()} == want
    assert written and written[0].count() <= 3 * 5


def test_unique_phrases_shuffle_passages_alone(spark):
    draw = random.Random(4)
    rows = [(d, c, " ".join(draw.choice("pqr") for _ in range(draw.randrange(5, 16)))) for d in [*range(6), 2, None] for c in range(5)]
    runs: dict[tuple, list] = {}
    for d, c, text in rows:
        t = text.split()
        for i in range(len(t) - 2 if len(t) >= 8 else 0):
            runs.setdefault((d, " ".join(t[i : i + 3])), []).append((c, i))
    want: dict[tuple, tuple] = {}
    for (d, p), at in runs.items():
        if len({c for c, _ in at}) == 1:
            want[d, at[0][0]] = min(want.get((d, at[0][0]), (99, "")), (min(i for _, i in at), p))
    got = S.unique_phrases(spark.createDataFrame(rows, "doc_id long, chunk long, text string"), 3)
    assert plan(got).count("Exchange") == 1
    assert {(r.doc_id, r.chunk): r.phrase for r in got.collect()} == {k: p for k, (_, p) in want.items()}


def test_an_index_is_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    texts = ["b a b", "", None, "a", "a", " ".join(f"w{i % 7}" for i in range(40))]
    rows = [(i // 2, t) for i, t in enumerate(texts)]  # two texts of each id
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    plans = []
    monkeypatch.setattr(S, "settled", lambda df, name="step", real=S.settled: plans.append((name, plan(df))) or real(df, name))
    postings, stats = S.stored_index(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(tuple(r) for r in postings.select("term", "doc_id", "dl", "tf").collect()) == sorted((w, d, len(t.split()), t.split().count(w)) for d, t in rows if t for w in set(t.split()))
    assert tuple(stats.first()) == (6, 45 / 6)
    assert all("Exchange" not in p for name, p in plans if name == "postings")


def test_nearest_vectors_with_ties_and_strange_ones(spark):
    draw = random.Random(5)
    rows = [(i, [float(draw.randrange(-2, 3)) for _ in range(3)] if i % 9 else [1.0, 2.0, -1.0]) for i in range(90)]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in rows]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9)
    got = S.knn(vectors, vectors.filter("vec_id < 5").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 7)
    for q, v in rows[:5]:
        want = [i for _, i in sorted((-cosine(v, w), i) for i, w in rows)[:7]]
        assert [r.vec_id for r in got.filter(F.col("query") == q).orderBy("place").collect()] == want


def test_the_band_join_spreads_its_pairs(spark):
    got = registry.QUERIES["rel_range_join"](spark, SF)
    assert "Broadcast" not in plan(got) and got.rdd.getNumPartitions() >= 4


def test_premises_are_joined_without_other_edges(spark):
    assert "% 50) = 0" in plan(registry.QUERIES["graph_why"](spark, SF))


def test_tasks_that_make_pairs_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(I, "TASK_PAIRS", 10)
    rows = [(d, (d * 7 + i * i) % 23) for d in range(20) for i in range(5)] + [(99, 1000), (3, None), (None, 4)]
    want: dict[tuple, float] = {}
    docs = {d: {e for d2, e in rows if d2 == d and e not in (1000, None)} for d in range(20)}
    for own in docs.values():
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0.0) + 1 / (len(own) - 1)
    got = I.co_occurrence(spark.createDataFrame(rows, "doc long, entity long"))
    assert got.rdd.getNumPartitions() > 4
    assert {(r.a, r.b): round(r.weight, 9) for r in got.collect()} == {k: round(w, 9) for k, w in want.items()}


def test_points_at_one_place_are_compared_once(spark):
    points = [(i, 10.0 + i % 2, 179.9) for i in range(40)] + [(50, 60.0, 0.0), (51, None, 1.0)]
    towns = [(t, 10.0, -179.9) for t in (9, 8, 12)] + [(3, 10.9, 179.5), (4, -60.0, 0.0)]
    got = N.nearest(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(towns, "town long, lat double, lon double"), 60.0)
    assert plan(got).count("keys=[lat") >= 2
    assert {r.id: r.town for r in got.collect()} == {i: 3 if i % 2 else 8 for i in range(40)}


def test_scores_of_many_queries_are_not_shuffled(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 9))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    asked = [(q, f"w{w}") for q in range(3) for w in range(q, 11, 3)]
    got = S.bm25_batch(S.stored_index(docs), spark.createDataFrame(asked + asked[:2], "query long, term string"))
    assert "hashpartitioning(query" not in plan(got)
    for q in range(3):
        want = {r.doc_id: r.score for r in S.bm25(docs, [w for q2, w in asked if q2 == q]).collect()}
        assert {r.doc_id: round(r.score, 9) for r in got.filter(F.col("query") == q).collect()} == {d: round(s, 9) for d, s in want.items()}


def test_pairs_that_share_too_little_are_not_compared_whole(spark, monkeypatch):
    draw = random.Random(6)
    sets = {i: set(range(12)) | {1000 * i + k for k in range(draw.randrange(20, 50))} for i in range(60)}
    for i in range(60, 80):
        sets[i] = {m for m in sets[i - 60] if draw.random() < 0.8} | {1000 * i + k for k in range(draw.randrange(9))}
    sets |= {90: set(), 91: {1}, 92: {1}, 93: {1, 2}, 94: {-5, 70_000}}
    written = {}
    monkeypatch.setattr(U, "settled", lambda df, name="step", real=U.settled: written.setdefault(name, real(df, name)))
    frame = spark.createDataFrame([(i, sorted(m)) for i, m in sets.items()], "doc_id long, s array<long>")
    for least in (0.1, 0.3, 0.9):
        written.clear()
        got = {(r.a, r.b): round(r.jaccard, 9) for r in U.class_pairs(frame, "doc_id", "s", least).collect()}
        alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] | sets[b] and 92 not in (a, b)}
        assert got == {k: round(j, 9) for k, j in alike.items() if j >= least}
        assert least < 0.3 or written["proposed-pairs"].count() <= 3 * len(got) + 10


def test_cited_works_are_told_from_references_read_once(spark):
    """A reference that one of its rows links to a document is held in all of them."""
    assert plan(registry.QUERIES["cite_missing"](spark, SF)).count("Generate explode") == 1
    refs = spark.createDataFrame([(1, "1:1", "10.1/a", "held by number"), (1, "1:1", None, "a work of the same number"), (2, "2:1", None, "a work of the same number"), (2, "2:2", "10.1/z", "held by its title"), (3, "3:1", "10.1/z", "another title"), (4, "4:1", None, "short")], "doc long, ref string, doi string, title string")
    by_doi = spark.createDataFrame([("10.1/a", 7), ("10.1/a", 8)], "doi string, doc_id long")
    by_title = spark.createDataFrame([(9, "heldbyitstitle"), (10, "twice"), (11, "twice")], "doc_id long, key string")
    assert [tuple(r) for r in K.missing_works(refs, by_doi, by_title, 5).collect()] == [("10.1/z", 1), ("aworkofthesamenumber", 1)]


def test_sets_of_shingles_are_made_once(spark):
    """Before, each set was made three times: for its class, for the classes' keys and for the pairs."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<bigint>")
    def members(i):
        made.add(1)
        return sorted([i // 2, 100, 101, 102])

    sets = spark.range(20).withColumn("s", members("id"))
    got = {(r.a, r.b): r.jaccard for r in U.class_pairs(sets, "id", "s", 0.5).collect()}
    assert got == {(2 * i, 2 * j): 0.6 for i in range(10) for j in range(i + 1, 10)}
    assert made.value == 20
