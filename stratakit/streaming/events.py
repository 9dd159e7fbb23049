"""Structured Streaming over append logs: ledgers, budgets, rate-limited opens, and windows by event time.

Windows and watermarks come with
Spark. Each function takes a DataFrame that may stream and returns one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def drop_folder(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tumbling(rows: DataFrame, at: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window; rows later than the watermark are dropped where rows stream."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(rows: DataFrame, at: str, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    return rows.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(rows: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def opens_once(rows: DataFrame, at: str, keys: list[str], within: str) -> DataFrame:
    """One row of equal keys within a span; the state forgets them after."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def spend(rows: DataFrame, step: str, usd: str) -> DataFrame:
    return rows.groupBy(step).agg(F.count("*").alias("calls"), F.sum(usd).alias("usd"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there and stop; offsets and state live in ``checkpoint``, so a run after a failure goes on where it ended."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    query.awaitTermination()
