"""Centroid clustering: Lloyd's rounds over cover trees of vectors and a tree of the round's centroids.

Vectors are dealt into blocks as the scan gives them; a task builds a cover tree
of each block's different vectors, once, and the trees are written. In each round
a task walks its trees together with the tree of the centroids: a pair of nodes is
dropped if no vector of the one can be as near to a centroid of the other as all
its vectors are to some centroid; a node with one centroid left is assigned whole;
what is left at leaves is compared exactly, in integers. What tasks return is a count and a sum for each centroid,
which the driver, who holds the centroids, divides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import common

DIMENSIONS, CENTROIDS, ROUNDS = 64, 16, 3
#: Rows whose vectors share a tree, and vectors that a leaf of it holds at most.
BLOCK, LEAF = 2_048, 8
#: Components are less than this in size, so that every distance is a long.
LARGEST = 1 << 26
LONG = (1 << 63) - 1


class Tree(NamedTuple):
    """Nodes level by level. A node has the points ``lo`` to ``hi`` of ``order``, its centre first, all within ``radius`` of it, and its children from ``child`` on."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of different points: a node of radius over 2^(i-1) has children whose centres are over 2^(i-1) from each other, each with the points within that of it."""
    points = points.astype(np.float64)
    order = np.arange(len(points))
    away = np.sqrt(((points - points[:1]) ** 2).sum(1))
    nodes: list[list[float]] = [[0, len(points), 0.0, 0, 0]]
    at = 0
    while at < len(nodes):
        lo, hi = int(nodes[at][0]), int(nodes[at][1])
        nodes[at][2] = radius = float(away[lo:hi].max())
        if hi - lo > leaf and radius > 0:
            half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            half = half / 2 if half >= radius else half
            left, far = order[lo:hi].copy(), away[lo:hi].copy()
            nodes[at][3] = len(nodes)
            while len(left):
                near = far <= half
                end = lo + int(near.sum())
                order[lo:end], away[lo:end] = left[near], far[near]
                nodes.append([lo, end, 0.0, 0, 0])
                nodes[at][4] += 1
                lo, left = end, left[~near]
                if len(left):
                    far = np.sqrt(((points[left] - points[left[0]]) ** 2).sum(1))
        at += 1
    lo, hi, radius, child, children = np.array(nodes).T
    return Tree(order, lo.astype(np.int64), hi.astype(np.int64), radius, child.astype(np.int64), children.astype(np.int64))


def spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each ``lo`` on, ``n`` of them, and which of the stretches each is from."""
    of = np.repeat(np.arange(len(n)), n)
    return lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


class Centroids:
    """A round's centroids and their tree; of equal ones only the first can be the nearest."""

    def __init__(self, rows: list[list[int]]):
        first: dict[tuple[int, ...], int] = {}
        for k, row in enumerate(rows):
            first.setdefault(tuple(row), k)
        points = np.array(list(first), np.int64)
        self.tree = cover_tree(points, 1)
        self.points = points[self.tree.order]
        self.numbers = np.array(list(first.values()), np.int64)[self.tree.order]


def nearest(points: np.ndarray, tree: Tree, centroids: Centroids) -> tuple[np.ndarray, int]:
    """The nearest centroid of each of ``points`` (in the tree's order), the first of equals, and how many pairs were compared exactly."""
    other, compared = centroids.tree, 0
    out = np.full(len(points), -1, np.int64)
    a = b = np.zeros(min(len(points), 1), np.int64)
    while len(a):
        d = np.sqrt(((points[tree.lo[a]] - centroids.points[other.lo[b]]).astype(np.float64) ** 2).sum(1))
        ra, rb = tree.radius[a], other.radius[b]
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        worst = np.minimum.reduceat(d + ra, head)[np.cumsum(np.append(0, a[1:] != a[:-1]))]
        # The slack is far above what rounding can do, so no equal is lost.
        stays = d - ra - rb <= worst + 1e-9 * (d + ra + rb + 1)
        a, b, rb = a[stays], b[stays], rb[stays]
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        count = np.diff(np.append(head, len(a)))
        node = a[head]
        wide = np.maximum.reduceat(np.where(other.children[b] > 0, rb, -1.0), head)
        whole = (count == 1) & (wide < 0)
        leaf = tree.children[node] == 0
        exact = ~whole & leaf & (wide < 0)
        split_b = ~whole & (wide >= 0) & (leaf | (wide >= tree.radius[node]))
        split_a = ~whole & ~exact & ~split_b
        if whole.any():
            at, of = spread(tree.lo[node[whole]], tree.hi[node[whole]] - tree.lo[node[whole]])
            out[at] = centroids.numbers[other.lo[b[head[whole]]]][of]
        if exact.any():
            pair = np.repeat(exact, count)
            at, of = spread(tree.lo[a[pair]], tree.hi[a[pair]] - tree.lo[a[pair]])
            c = other.lo[b[pair]][of]
            distance = ((points[at] - centroids.points[c]) ** 2).sum(1)
            by = np.lexsort((centroids.numbers[c], distance, at))
            first = by[np.append(True, at[by][1:] != at[by][:-1])]
            out[at[first]] = centroids.numbers[c[first]]
            compared += len(at)
        pair = np.repeat(split_b, count)
        deep = pair & (other.children[b] > 0)
        below, of = spread(other.child[b[deep]], other.children[b[deep]])
        kids, group = spread(tree.child[node[split_a]], tree.children[node[split_a]])
        pairs, kid = spread(head[split_a][group], count[split_a][group])
        new_a = np.concatenate([a[pair & ~deep], a[deep][of], kids[kid]])
        new_b = np.concatenate([b[pair & ~deep], below, b[pairs]])
        by = np.argsort(new_a, kind="stable")
        a, b = new_a[by], new_b[by]
    return out, compared


TREES = "ids array<long>, places array<int>, points binary, lo binary, hi binary, radius binary, child binary, children binary"
_TREES = pa.schema([("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("points", "lo", "hi", "radius", "child", "children")]])


def trees_of(vectors: DataFrame, dimensions: int) -> DataFrame:
    """A row for each block of ``vectors`` (vec_id long, v array<int>): the tree of its different vectors, their places in it and the ids of the rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        rows: list[np.ndarray] = []

        def block(n: int) -> pa.RecordBatch:
            nonlocal ids, rows
            points, who = np.concatenate(rows), pa.concat_arrays(ids)
            ids, rows = [who[n:]], [points[n:]]
            different, place = np.unique(points[:n], axis=0, return_inverse=True)
            tree = cover_tree(different)
            rank = np.empty(len(different), np.int32)
            rank[tree.order] = np.arange(len(different))
            data = [different[tree.order].astype("<i4"), *(x.astype("<i4") for x in (tree.lo, tree.hi)), tree.radius.astype("<f8"), *(x.astype("<i4") for x in (tree.child, tree.children))]
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (who[:n], pa.array(rank[place.ravel()], pa.int32()))]
            return pa.RecordBatch.from_arrays([*lists, *[pa.array([x.tobytes()], pa.binary()) for x in data]], schema=_TREES)

        held = 0
        for batch in batches:
            ids.append(batch.column(0))
            rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
            held += batch.num_rows
            while held >= BLOCK:
                yield block(BLOCK)
                held -= BLOCK
        if held:
            yield block(held)

    return common.written(vectors.mapInArrow(build, TREES), "cover-trees", keep=True)


def walked(trees: DataFrame, centroids: list[list[int]], dimensions: int, schema: str, use: Callable[[Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``use`` makes of (ids, places, points, nearest centroids of points) of a task's blocks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Centroids(centroids)

        def blocks() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, places = (batch.column(c)[k].values for c in (0, 1))
                    kinds = ("<i4", "<i4", "<i4", "<f8", "<i4", "<i4")
                    data = [np.frombuffer(batch.column(2 + c)[k].as_py(), t) for c, t in enumerate(kinds)]
                    points = data[0].reshape(-1, dimensions).astype(np.int64)
                    ints = [data[c].astype(np.int64) for c in (1, 2, 4, 5)]
                    tree = Tree(np.arange(len(points)), ints[0], ints[1], data[3], ints[2], ints[3])
                    yield ids, places.to_numpy(), points, nearest(points, tree, held)[0]

        return use(blocks())

    return trees.mapInArrow(walk, schema)


def means(trees: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """The floors of the means of each centroid's vectors; one without vectors stays. Tasks and the shuffle carry a count and a sum a centroid."""

    def total(blocks: Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), dimensions), np.int64)
        for _, places, points, at in blocks:
            weights = np.bincount(places, minlength=len(points))
            np.add.at(n, at, weights)
            by = np.argsort(at, kind="stable")
            head = np.flatnonzero(np.append(True, at[by][1:] != at[by][:-1]))
            sums[at[by][head]] += np.add.reduceat((points * weights[:, None])[by], head)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    rows = walked(trees, centroids, dimensions, "cluster long, n long, sums array<long>", total)
    rows = rows.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(dimensions)]).collect()
    new = {r[0]: [int(s) // r[1] for s in r[2:]] for r in rows}
    return [new.get(k, row) for k, row in enumerate(centroids)]


def dual_tree_lloyd(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every row of ``vectors`` (vec_id long, v array<int>) after some rounds from given centroids, and the last centroids.

    Vectors have as many components as centroids, all less than ``LARGEST`` in size.
    A row of a vector that others have too, a repeated or a null id is a row of
    its own; equal distances go to the smaller number. The trees stay as long as
    the scope they are made in.
    """
    dimensions = len(centroids[0])
    trees = trees_of(vectors, dimensions)
    for _ in range(rounds):
        centroids = means(trees, centroids, dimensions)

    def assign(blocks: Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ends = np.array(centroids, np.int64)
        for ids, places, points, at in blocks:
            distance = ((points - ends[at]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at[places].astype(np.int32)), pa.array(distance[places])], names=["vec_id", "cluster", "distance"])

    return walked(trees, centroids, dimensions, "vec_id long, cluster int, distance long", assign), centroids


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``embeddings`` with 64 components, none null or non-finite.

    A null id is a row like others, its hash that of ``1:``; rows of one id go by
    their components. With fewer than 16 vectors there are as many centroids as
    vectors, with none no rows. A component of 2^20 or more, times 64, is an
    error, as its distances may not fit a long; a sum of distances that does not is null.
    """
    x = F.col("embedding")
    whole = (F.size(x) == DIMENSIONS) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    step = lambda c: F.when(F.abs(c) < LARGEST // 64, F.floor(64 * c.cast("double"))).otherwise(F.raise_error(F.lit("a component of a vector is too large")).cast("long")).cast("int")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, step).alias("v"))
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [list(r.v) for r in rows.orderBy(key, "v").limit(CENTROIDS).select("v").collect()]
    if not start:
        return spark.createDataFrame([], RESULT)
    found, ends = dual_tree_lloyd(rows, start)
    found = common.written(found, "assigned", keep=True)
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda n: n if n <= LONG else None
    facts = [(k, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, s in sums.items()]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    away = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM k ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': {away}, 'c': c.c}}) AS m FROM k CROSS JOIN c{i} c GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT m.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {DIMENSIONS + 1}) t(i) GROUP BY ALL), n{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (c))")
    end = f"SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.c = m.c"
    return f"WITH {', '.join(parts)} {end}"


OP13_SQL = _sql()
