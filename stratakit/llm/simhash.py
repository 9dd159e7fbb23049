"""Near-duplicates by SimHash: fingerprints within ``DISTANCE`` bits, searched by the general pigeonhole principle.

Fingerprints are parted into groups of correlated bits. With m groups of bits
and thresholds t_i that sum to DISTANCE - m + 1, two fingerprints within
DISTANCE bits are within t_i bits in some group i (t_i = -1: that group need not
be probed). The thresholds are allocated by dynamic programming on candidate
counts estimated from all fingerprints, the number of groups by the same cost.
Buckets of a few members are compared pair by pair. In a crowded bucket (near
copies of one text) pairs would grow with the square, so its members are linked
through the fingerprints one bit away: two are within two bits of each other
just if they share such a neighbour or themselves, and at most 65 share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import common, graph, nearcopies

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 3, 2
#: Members of a bucket up to which they are compared pair by pair.
CROWD = 32
#: Shingles whose bits are counted at a time, whatever the length of the text.
BLOCK = 1 << 14
#: Cost of a probe in units of one candidate's check.
PROBE_COST = 4.0
GROUPS = (1, 2, 3, 4)


def fingerprint(text: bytes | None) -> int:
    """The signed 64-bit SimHash of a text in UTF-8; 0 for a text with no word."""
    words = (text or b"").translate(common.FOLD).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, stops = [0, *ends[: n - 1]], ends[SHINGLE - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary())
        marks = pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())
        rest = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], marks], names=[*[batch.schema.names[i] for i in rest], "fp"])


def with_fingerprints(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``fp`` of every row; ``text`` is read whole."""
    rows = docs.select(*columns, F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(_fingerprints, f"{schema}, fp bigint")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many fingerprints have bits i and j set, for all i and j; a task's own sums."""
    both = np.zeros((BITS, BITS))
    for batch in batches:
        marks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for k in range(0, len(bits), 1 << 16):
            both += bits[k : k + (1 << 16)].T @ bits[k : k + (1 << 16)]
    yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(both.ravel().astype(np.int64))], names=["k", "v"])


def group_bits(both: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Bits 0 to 63 in ``groups`` groups of near equal width, each grown by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(near, 0)
    left, out = list(range(BITS)), []
    for g in range(groups):
        width = len(left) // (groups - g)
        own = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (near[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Thresholds (from -1) that sum to distance - groups + 1 at the least total cost; costs[i][t + 1] is group i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                if (found := (cost + row[t + 1], [*chosen, t]))[0] < step.get(total + t, (float("inf"),))[0]:
                    step[total + t] = found
        best = step
    return best[distance - len(costs) + 1]


def mask_of(bits: tuple[int, ...] | list[int]) -> int:
    """The bits as a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def plan(marks: DataFrame) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, from statistics over all of ``marks`` (distinct ``fp``)."""
    sums = marks.select("fp").mapInArrow(_bit_counts, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v")).collect()
    both, n = np.zeros(BITS * BITS), marks.count()
    for k, v in sums:
        both[k] = v
    both = both.reshape(BITS, BITS)
    parts = {m: group_bits(both, n, m) for m in GROUPS}
    masks = sorted({mask_of(bits) for groups in parts.values() for bits in groups})
    keys = marks.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x).cast("long")).alias("key")) for i, x in enumerate(masks)])).alias("k"))
    sizes = keys.groupBy("k").agg(F.count("*").alias("c")).groupBy("k.i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    pairs = {masks[i]: v for i, v in sizes.collect()}
    p = np.diag(both) / max(n, 1)
    agree = p**2 + (1 - p) ** 2
    found = []
    for groups in parts.values():
        costs = []
        for bits in groups:
            # Pairs that differ in just d bits of the group, in proportion to those that differ in none, were the bits independent.
            odds = np.zeros(DISTANCE + 1)
            odds[0] = 1.0
            for b in bits:
                odds[1:] += odds[:-1] * (1 - agree[b]) / agree[b]
            row = [0.0]
            for t in range(DISTANCE + 1):
                probes = sum(comb(len(bits), d) for d in range(t + 1))
                row.append(PROBE_COST * n * probes + max(pairs.get(mask_of(bits), 0.0), 0.5 * n * n / 2.0 ** len(bits)) * odds[: t + 1].sum())
            costs.append(row)
        found.append((*allocate(costs), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]


def links(marks: DataFrame, probes: list[tuple[list[int], int]]) -> DataFrame:
    """Links (a, b) that join all ``fp`` within ``DISTANCE`` bits into the same components."""
    if DISTANCE != 2:
        raise ValueError("crowded buckets are linked through neighbours at one bit, which holds for a distance of two")
    fp = F.col("fp")
    own, probed = [], []
    for i, (bits, t) in enumerate(probes):
        key = fp.bitwiseAND(F.lit(mask_of(bits)).cast("long"))
        own.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
        flips = [mask_of(x) for d in range(t + 1) for x in combinations(bits, d)]
        probed += [F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(x).cast("long")).alias("key")) for x in flips]
    members = marks.select("fp", F.explode(F.array(*own)).alias("_k")).select("fp", "_k.part", "_k.key")
    crowds = members.groupBy("part", "key").agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWD)
    crowds = common.written(crowds, "crowds")
    members = common.written(common.attach(members, crowds, ["part", "key"], salt_by=["fp"]), "members")
    few = members.filter(F.col("_n").isNull()).select("part", "key", F.col("fp").alias("b"))
    asks = marks.select(F.col("fp").alias("a"), F.explode(F.array(*probed)).alias("_k")).select("a", "_k.part", "_k.key")
    pairs = asks.join(few, ["part", "key"]).filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    # Crowds: members and whatever probes their bucket; a probe may come from outside.
    reached = asks.join(crowds.select("part", "key"), ["part", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()
    flips = F.array(fp, *[fp.bitwiseXOR(F.lit(mask_of([b])).cast("long")) for b in range(BITS)])
    near = reached.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("_m")).filter(F.size("_m") > 1)
    stars = near.select(F.array_min("_m").alias("a"), F.explode("_m").alias("b")).filter("a <> b")
    return pairs.unionByName(stars)


def classes(rows: DataFrame, name: str = "doc_id") -> DataFrame:
    """(fp, root, component_id, copies) for every distinct ``fp`` of ``rows`` (``name``, ``fp``), as a written table.

    ``component_id`` is the least ``name`` in the component, null if all are null.
    """
    with common.scope():
        marks = common.written(rows.groupBy("fp").agg(F.min(name).alias("_least"), F.count("*").alias("copies")), "fingerprints")
        roots = graph.components(links(marks, plan(marks)))
        placed = marks.join(roots, marks["fp"] == roots["node"], "left").select("fp", "_least", "copies", F.coalesce("root", "fp").alias("root"))
        placed = common.written(placed, "placed")
        least = common.written(placed.groupBy("root").agg(F.min("_least").alias("component_id")), "least-ids")
        return common.written(placed.join(least, "root").select("fp", "root", "component_id", "copies"), "classes", keep=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, repeated ones too.

    Null and empty texts have fingerprint zero and are linked like any other; a
    text of any length is read whole; a component of null ids alone has a null
    id; an empty table gives an empty result; other columns are not read.
    """
    rows = common.written(with_fingerprints(common.documents(spark, sf_dir), ["doc_id"]), "document-fingerprints")
    found = classes(rows)
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@common.staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (``nearcopies``: five words, similarity 0.8) the row with the least doc_id stays, all columns unchanged.

    ``docs`` is read from files, twice. Of equal rows one stays; null ids come
    last; texts without a word are copies of each other; a text of any length is
    read whole; an empty table gives an empty result; no column name is reserved.
    The rows that stay are marked by their numbers: texts are not shuffled.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = common.numbered(docs, at)
    with common.scope():
        texts = rows.select("_row", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
        sets = common.written(nearcopies.with_sets(texts), "shingled")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
        firsts = common.written(sets.groupBy("_set").agg(F.min("_row").alias("_first"), F.min(order).alias("_best")).drop("_set"), "set-firsts")
        roots = graph.components(nearcopies.links(texts, sets, firsts)).select(F.col("node").alias("_first"), "root")
        best = firsts.join(roots, "_first", "left").groupBy(F.coalesce("root", "_first").alias("root")).agg(F.min("_best").alias("_best"))
        kept = common.mark_rows(best.select("_best._row"), keep=True)
    return common.only_marked(rows, kept).select(*names).toDF(*docs.columns)
