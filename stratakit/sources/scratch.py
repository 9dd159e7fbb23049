"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder of the machine only where none is set and all runs on it, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(f"file://{tempfile.mkdtemp(prefix='stratakit-')}")
        path = _own_dir[0]
    return path.rstrip("/")


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows as a written table: computed once, its plan a scan, kept if an executor is lost."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stratakit/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
