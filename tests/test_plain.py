"""Queries that SQL cannot express, and functions of several parts, against plain versions on small tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.operators import dedupe as U
from stratakit.operators import inference as I
from stratakit.operators import knowledge as K
from stratakit.operators import sessions as S
from stratakit.streaming import events as E


def test_platt_maximises_the_likelihood(spark):
    draw = random.Random(2)
    rows = [(p := draw.uniform(0.02, 0.98), int(draw.random() < p**2)) for _ in range(400)]
    a, b = S.platt(spark.createDataFrame(rows, "p double, y int"))
    logit = lambda p: math.log(p / (1 - p))

    def likelihood(a, b):
        return sum(math.log(q if y else 1 - q) for p, y in rows for q in [1 / (1 + math.exp(-(a * logit(p) + b)))])

    best = likelihood(a, b)
    assert all(best >= likelihood(a + da, b + db) - 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def pooled(rows):
    """Pool adjacent violators by hand: (p, fitted)."""
    by_p: dict[float, list[int]] = {}
    for p, y in rows:
        by_p.setdefault(p, []).append(y)
    blocks: list[list[float]] = []
    for p in sorted(by_p):
        blocks.append([sum(by_p[p]), len(by_p[p]), p])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, last]
    fitted, at = {}, 0
    for p in sorted(by_p):
        while p > blocks[at][2]:
            at += 1
        fitted[p] = blocks[at][0] / blocks[at][1]
    return fitted


def test_isotonic_equals_pooling(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(20) / 20, draw.randrange(2)) for _ in range(200)]
    want = pooled(rows)
    got = {r.bound: r.value for r in S.isotonic(spark.createDataFrame(rows, "p double, y int")).collect()}
    assert got and all(want[p] == pytest.approx(v) for p, v in got.items())
    assert {round(v, 9) for v in got.values()} == {round(v, 9) for v in want.values()}


def test_near_names(spark):
    names = ["sound synthesis overview", "sound synthesis  overview", "sound synthesis overviews of the year 2012", "ismir 17 proceedings", "ismir 20 proceedings", "short", "a quite different name"]
    got = U.near_names(spark.createDataFrame(list(enumerate(names)), "id int, name string"), 0.8).collect()
    assert {(r.a, r.b) for r in got} == {(0, 1)}


def test_page_text(spark):
    page = "<html><head><title>t</title></head><body><script>x()</script><!-- c --><nav>menu</nav><h1>Head</h1><p>One&nbsp;two\n three</p></body></html>"
    (r,) = spark.createDataFrame([(page,)], "html string").select(T.html_text(F.col("html")).alias("t")).collect()
    assert "Head" in r.t and "three" in r.t and not any(x in r.t for x in ("menu", "x()", "<", " c "))


def test_large_documents_and_many_copies_keep_their_pairs(spark):
    members = [(d, e) for d in (1, 2) for e in range(100)] + [(3, 0), (3, 1)]
    got = I.co_occurrence(spark.createDataFrame(members, "doc int, entity int"), block=16)
    assert got.count() == 4950 and got.filter("a = 0 AND b = 1").first().weight == pytest.approx(2 / 99 + 1)
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, text) for i in range(200)] + [(900, text + " more")], "doc_id bigint, text string").select("doc_id", U.shingle_hashes(F.col("text")).alias("s"))
    classes = U.set_classes(docs, "doc_id", "s")
    assert classes.filter("class = 0").count() == 200
    assert [(r.a, r.b) for r in U.class_pairs(docs, "doc_id", "s", 0.5).collect()] == [(0, 900)]


@pytest.mark.parametrize("least", [0.1, 0.5, 0.9])
def test_class_pairs_miss_none(spark, least):
    draw = random.Random(int(least * 10))
    rows = [(i, sorted({draw.randrange(12) for _ in range(draw.randrange(0, 7))})) for i in range(60)]
    first: dict[tuple, int] = {}
    for i, m in rows:
        if m:
            first.setdefault(tuple(m), i)
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and len({*x} & {*y}) >= least * len({*x} | {*y}) - 1e-9}
    got = U.class_pairs(spark.createDataFrame(rows, "id int, m array<bigint>"), "id", "m", least)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_acronyms(spark):
    said = "We use the finite difference method (FDM), a so-called virtual analog anti-aliasing (VAAA) and digital (XYZ). Of the wave digital filters (WDF)."
    (r,) = spark.createDataFrame([(said,)], "t string").select(K.acronyms(F.col("t")).alias("a")).collect()
    assert {(x.acronym, x.phrase) for x in r.a} == {("fdm", "finite difference method"), ("vaaa", "virtual analog anti aliasing"), ("wdf", "wave digital filters")}


def test_dates_that_are_none(spark):
    said = ["2019-13-01", "40 May 2019", "May 99, 2019", "3 Foo 2019", "", None, "jänner 2020", "3. décembre 2001", "2019-07"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", T.partial_date(F.col("s")).alias("d")).orderBy("i").collect()
    assert [r.d and tuple(r.d) for r in rows] == [None, None, None, None, None, None, ("2020-01", "month"), ("2001-12-03", "day"), ("2019-07", "month")]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Opens within half an hour count once; a second run reads new files alone and still knows what was open."""
    schema = "doc int, via string, at timestamp"
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    write = lambda rows: spark.createDataFrame(rows, "doc int, via string, at string").selectExpr("doc", "via", "timestamp(at) AS at").coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: E.opens_once(E.drop_folder(spark, folder, spark.createDataFrame([], schema).schema), "at", ["doc", "via"], "30 minutes")
    write([(1, "web", "2024-01-01 10:00:00"), (1, "web", "2024-01-01 10:05:00"), (2, "web", "2024-01-01 10:06:00")])
    E.run_to_end(stream(), out, state)
    assert sorted((r.doc, r.via) for r in spark.read.parquet(out).collect()) == [(1, "web"), (2, "web")]
    write([(1, "web", "2024-01-01 10:10:00"), (1, "mail", "2024-01-01 10:11:00"), (3, "web", "2024-01-01 12:00:00")])
    E.run_to_end(stream(), out, state)
    assert sorted((r.doc, r.via) for r in spark.read.parquet(out).collect()) == [(1, "mail"), (1, "web"), (2, "web"), (3, "web")]
    write([(1, "web", "2024-01-01 13:00:00")])
    E.run_to_end(stream(), out, state)
    assert spark.read.parquet(out).filter("doc = 1 AND via = 'web'").count() == 2
