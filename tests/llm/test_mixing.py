from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratakit.llm import common, mixing


def sizes(rows):
    return [len(re.findall(common.WORD_PATTERN, r.text or "")) for r in rows]


def slow_targets(total_of: dict) -> dict:
    """Share again and again what is above twice a source's size."""
    order = sorted(total_of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        rest = 1.5 * sum(total_of.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        now = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if now[s] > 2 * total_of[s]]
        if not above:
            return fixed | now
        fixed |= {s: 2.0 * total_of[s] for s in above}


def check(docs, got):
    rows = docs.select("doc_id", "source", "text").collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, n) for r, n in zip(rows, sizes(rows), strict=True))
    total = defaultdict(int)
    for r, n in zip(rows, sizes(rows), strict=True):
        total[r.source] += n
    want = slow_targets(total)
    source_of = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0 and r.taken <= 2 * r.size
        if r.doc_id is not None:
            s = source_of[r.doc_id]
            assert r.source_size == total[s] and r.target == pytest.approx(want[s])
            assert r.size == 0 or int(r.target / r.source_size) <= r.taken // r.size <= int(r.target / r.source_size) + 1
            taken[s] += r.taken
    return taken, want


def test_query_meets_targets(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001")
    got = mixing.op8_mixing(spark, "/root/testdata/sf0.001").collect()
    taken, want = check(docs, got)
    most = defaultdict(int)
    for r, n in zip(rows := docs.collect(), sizes(rows), strict=True):
        most[r.source] = max(most[r.source], n)
    for s in want:  # one fraction is left to round in the end
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op8_mixing(spark, "/root/testdata/sf0.001").collect()))


def test_odd_rows(spark, odd_docs, no_docs, as_tables):
    check(odd_docs, mixing.op8_mixing(spark, as_tables(documents=odd_docs)).collect())
    kept = mixing.stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and kept.count() > 0
    assert mixing.stage(spark, no_docs, "").count() == 0


def test_words_are_kept_through_all_levels(spark):
    """Equal sizes: the number rounded up is the sum of the fractions, whatever the levels; expectations hold."""
    n, p = 5000, 0.3
    items = spark.range(n).selectExpr("'a' AS source", f"{n}L AS docs", "7L AS size", "id AS row", "xxhash64(id) AS h", f"{p}D AS p")
    got = mixing.rounded(items)
    assert got.count() == n == got.select("row").distinct().count()
    assert abs(got.agg(F.sum("up")).first()[0] - n * p) <= 1
    halves = got.withColumn("low", F.col("row") < n // 2).groupBy("low").agg(F.avg("up").alias("m")).collect()
    assert all(abs(r.m - p) < 0.05 for r in halves)


def test_stage_takes_the_rows_of_the_query_and_shuffles_no_text(spark, tmp_path):
    """Before, the rows that are taken were joined with the texts by their numbers."""
    path = f"{tmp_path}/documents.parquet"
    docs = common.documents(spark, "/root/testdata/sf0.001")
    docs.repartition(3).write.parquet(path)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.stage(spark, spark.read.parquet(path), "")
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        want = Counter({r.doc_id: r.taken // r.size for r in mixing.op8_mixing(spark, str(tmp_path)).collect() if r.size})
        got = Counter(r.doc_id for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert {i: got[i] for i in want} == dict(want) and max(want.values()) == 2
