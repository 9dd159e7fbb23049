"""Shards of near equal bytes by sampled splitters.

Records are keyed by a hash of id and text. A size-weighted sample of keys gives
quantile boundaries, which range-partition the records; ranges whose bytes turn
out above ``OVERFULL`` times their share are subdivided by a sample of their own
until none is, or a record alone is larger. Ranges then follow one another: from
exact totals of the ranges and running sums within each, every record has its
byte position, and a shard is an equal share of all bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.llm import common

N_SHARDS = 24
#: Bytes a record counts besides its text.
RECORD_BYTES = 8
#: Records a range should hold, samples drawn for each range, and most ranges that one sample on the driver parts; in a larger table ranges hold more records.
RANGE_ROWS, DRAWS, MOST_RANGES = 2_000, 24, 16_384
OVERFULL = 2.0


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, tie): the narrow table that is sharded. A null text has no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("key"))
    # Rows alike in id and text share a key; where they stand in the table parts them.
    return common.written(rows.withColumn("tie", F.xxhash64("doc_id", F.monotonically_increasing_id())), "shard-rows")


def sample(rows: DataFrame, per: str, draws: int, seed: int) -> DataFrame:
    """Keys drawn with a chance in proportion to size, ``draws`` for each value of ``per`` (with its ``_bytes``) on average; written, so that it is drawn once."""
    chance = F.least(F.lit(1.0), draws * F.col("size") / F.col("_bytes"))
    coin = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "tie"), 11) / F.lit(float(1 << 53))
    return common.written(rows.filter(coin < chance).select(per, "key", "tie"), "splitter-sample")


def splitters(drawn: list[tuple[int, int]], n: int) -> np.ndarray:
    """At most n - 1 quantile boundaries (key, tie) of the drawn keys, ascending and distinct."""
    order = np.array(sorted(drawn), np.int64).reshape(-1, 2)
    at = np.unique((np.arange(1, n) * len(order)) // n)
    return np.unique(order[at[at < len(order)]], axis=0) if len(order) else order


def place(keys: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each (key, tie): how many boundaries are at or below it."""
    if not len(bounds):
        return np.zeros(len(keys), np.int64)
    low, high = np.searchsorted(bounds[:, 0], keys, "left"), np.searchsorted(bounds[:, 0], keys, "right")
    out = high.copy()
    for i in np.flatnonzero(high > low):  # a key that is itself a boundary: compare ties
        out[i] = low[i] + np.searchsorted(bounds[low[i] : high[i], 1], ties[i], "right")
    return out


def ranged(rows: DataFrame, bounds: dict[int, np.ndarray], name: str) -> DataFrame:
    """``rows`` (key, tie, path: array of the ranges so far) with the next range appended to ``path``, written.

    ``bounds`` has the boundaries within each range that is subdivided, by its
    number in ``node``; other rows get 0.
    """
    held = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def child(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for node, key, tie in batches:
            out = np.zeros(len(key), np.int64)
            for n in node.unique():
                if (own := held.value.get(int(n))) is not None:
                    at = np.flatnonzero(node.to_numpy() == n)
                    out[at] = place(key.to_numpy()[at], tie.to_numpy()[at], own)
            yield pd.Series(out.astype(np.int32))

    return common.written(rows.withColumn("path", F.concat("path", F.array(child("node", "key", "tie")))).drop("node"), name)


def ranges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``path`` (ascending as the keys are), and (path, _rows, _bytes) of each range."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    out = rows.withColumn("path", F.array().cast("array<int>")).withColumn("node", F.lit(0))
    drawn = sample(out.withColumn("_bytes", F.lit(max(total, 1))), "node", DRAWS * wanted, 1)
    out = ranged(out, {0: splitters([(r.key, r.tie) for r in drawn.collect()], wanted)}, "shard-ranges")
    share, step, before = max(total / wanted, 1.0), 0, None
    while True:
        totals = common.written(out.groupBy("path").agg(F.count("*").alias("_rows"), F.sum("size").alias("_bytes")), "range-totals")
        over = totals.filter((F.col("_bytes") > OVERFULL * share) & (F.col("_rows") > 1)).collect()  # of at most total / share ranges
        left = sorted((r._rows, r._bytes) for r in over)
        if left == before:  # what is overfull still is one record with few others
            break
        before, step = left, step + 1
        if not over:
            break
        parts = {i: max(2, -(-int(r._bytes) // int(share))) for i, r in enumerate(over, 1)}
        nodes = rows.sparkSession.createDataFrame([(i, r.path, r._bytes) for i, r in enumerate(over, 1)], "node int, path array<int>, _bytes long")
        out = out.join(F.broadcast(nodes), "path", "left").withColumn("node", F.coalesce("node", F.lit(0)))
        drawn: dict[int, list[tuple[int, int]]] = {}
        for r in sample(out.filter("node > 0"), "node", DRAWS * max(parts.values()), 2 + step).collect():
            drawn.setdefault(r.node, []).append((r.key, r.tie))
        out = ranged(out.drop("_bytes"), {i: splitters(drawn.get(i, []), k) for i, k in parts.items()}, "shard-ranges")
    return out, totals


def assign(docs: DataFrame, shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Shards are equal shares of all bytes to within a record; slots count from 0
    in key order. Rows alike in everything are records of their own; null ids
    and texts are records like any other; an empty table gives an empty result.
    """
    rows, totals = ranges(sized(docs))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_bytes")]
    starts = common.written(totals.select("path", *sums, F.sum("_bytes").over(Window.partitionBy()).alias("_total")), "range-starts")
    rows = common.attach(rows, starts, ["path"], salt_by=["tie"])
    within = Window.partitionBy("path").orderBy("key", "tie", "size")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_bytes_before") + F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.col("size") / 2
    rows = rows.withColumn("_n", F.col("_rows_before") + F.row_number().over(within) - 1)
    rows = rows.withColumn("shard", F.least(F.floor(middle * shards / F.col("_total")), F.lit(shards - 1)).cast("int"))
    rows = common.written(rows.select("doc_id", "size", "text_crc32", "shard", "_n"), "sharded")
    first = rows.groupBy("shard").agg(F.min("_n").alias("_first"))
    out = rows.join(F.broadcast(first), "shard")  # a row a shard
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_n") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, by ``assign``: null and empty texts weigh 8 bytes, a text of any length is one record, repeated rows are records of their own, other columns are not read."""
    return assign(common.documents(spark, sf_dir))
