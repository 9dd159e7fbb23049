from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from stratakit.llm import lloyd as L


def slow_nearest(points, rows):
    return [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(rows))[1] for p in points.tolist()]


def slow(rows):
    """(vec_id, embedding) by the plain rounds of the contract."""
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    at = lambda v, cs: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs))
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cs = [v for _, v in named[:16]]
    for _ in range(3):
        groups = {}
        for _, v in kept:
            groups.setdefault(at(v, cs)[1], []).append(v)
        cs = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(cs)]
    found = [(i, *at(v, cs)) for i, v in kept]
    inertia = lambda k=None: sum(d for _, d, c in found if k in (None, c))
    return [(i, c, d, inertia(c), inertia(), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, d, c in found]


@pytest.mark.parametrize("leaf", [1, 3, 8])
def test_trees_cover_and_separate(leaf):
    draw = np.random.default_rng(leaf)
    points = np.unique(draw.integers(-40, 40, (300, 3)), axis=0)
    t = L.cover_tree(points, leaf)
    assert sorted(t.order.tolist()) == list(range(len(points)))
    for n in range(len(t.lo)):
        own = points[t.order[t.lo[n] : t.hi[n]]]
        assert np.sqrt(((own - own[0]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
        kids = range(t.child[n], t.child[n] + t.children[n])
        if len(kids):
            assert [t.lo[k] for k in kids] == [t.lo[n], *[t.hi[k] for k in kids][:-1]] and t.hi[kids[-1]] == t.hi[n]
            centres = points[t.order[[t.lo[k] for k in kids]]].astype(float)
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(2))[np.triu_indices(len(kids), 1)]
            assert apart.min() > max(t.radius[k] for k in kids) - 1e-9
        else:
            assert len(own) <= leaf


@pytest.mark.parametrize("seed", range(6))
def test_nearest_equals_all_pairs_with_ties(seed):
    draw = np.random.default_rng(seed)
    points = np.unique(draw.integers(-6, 6, (500, 2 + seed)), axis=0)
    rows = draw.integers(-6, 6, (1 + 7 * seed, 2 + seed)).tolist() * 2
    t = L.cover_tree(points)
    got, _ = L.nearest(points[t.order], t, L.Centroids(rows))
    assert got.tolist() == slow_nearest(points[t.order], rows)


def test_far_groups_are_pruned():
    draw = np.random.default_rng(1)
    centres = draw.integers(-5_000, 5_000, (16, 64))
    points = np.unique(np.concatenate([c + draw.integers(-9, 9, (60, 64)) for c in centres]), axis=0)
    t = L.cover_tree(points)
    got, compared = L.nearest(points[t.order], t, L.Centroids(centres.tolist()))
    assert got.tolist() == slow_nearest(points[t.order], centres.tolist()) and compared < len(points)


def test_query_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, L.op13_centroids(spark, sf).collect()))
    assert got == sorted(slow(rows)) and got
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert sorted(con.sql(L.OP13_SQL).fetchall()) == got


@pytest.mark.parametrize("block", [7, 2_048])
def test_odd_rows(spark, as_tables, monkeypatch, block):
    """Nulls, wrong lengths, non-finite components, copies of one vector, repeated and null ids, clashing columns."""
    monkeypatch.setattr(L, "BLOCK", block)
    draw = np.random.default_rng(5)
    vectors = [draw.normal(size=64).round(2).tolist() for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(100 + k, vectors[0]) for k in range(30)]
    rows += [(3, vectors[7]), (3, vectors[3]), (None, vectors[5]), (None, vectors[6]), (200, None), (201, []), (202, vectors[0][:63]), (203, [*vectors[0], 1.0])]
    rows += [(204, [None, *vectors[0][1:]]), (205, [math.nan, *vectors[0][1:]]), (206, [-math.inf, *vectors[0][1:]]), (207, [0.0] * 64), (208, [-0.001] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS v", "3 AS distance", "4 AS n")
    got = sorted(map(tuple, L.op13_centroids(spark, as_tables(embeddings=table)).collect()), key=str)
    assert got == sorted(slow(rows), key=str)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, as_tables, n):
    rows = [(k, [float(k % 4)] * 64) for k in range(n)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, L.op13_centroids(spark, as_tables(embeddings=table)).collect())) == sorted(slow(rows))
