"""What the corpus operators share: the shared folder, written tables, salted joins, text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.llm import files

#: White space of every word rule here: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The same folding on UTF-8 bytes; bytes.split() then splits at exactly the white space above.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Most rows a broadcast side may have; beyond, the join is salted and shuffled.
BROADCAST_ROWS = 20_000


_own_dir: list[str] = []
#: Tables of the work in progress, innermost last, and those of the pipeline stage before.
_scopes: list[list[str]] = []
_left: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; a temporary one where none is named and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(f"file://{tempfile.mkdtemp(prefix='stratakit-')}")
        path = _own_dir[0]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new place in the shared folder, noted for the scope it belongs to; with ``keep`` for the one around that."""
    path = f"{shared_dir(spark)}/stratakit/{name}-{uuid.uuid4().hex}"
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    return path


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside go when it ends, but for those that ``keep`` hands to the scope around it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files.remove(path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: computed once, kept if an executor is lost. ``keep``: it outlives the scope it is made in."""
    spark = df.sparkSession
    path = new_path(spark, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what the last pipeline stage left for its result, which has been written by now."""
    while _left:
        files.remove(_left.pop())


def staged(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A pipeline stage whose tables go when the next one begins. The caller writes the result before that."""

    @wraps(stage)
    def applied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release()
        _scopes.append([])
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _left.extend(_scopes.pop())

    return applied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def sliced(n_keys: Column | int, *keys: Column, seed: int = 0) -> Column:
    """A stable number from 0 to n_keys - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n_keys) if isinstance(n_keys, int) else n_keys)


def attach(big: DataFrame, small: DataFrame, on: list[str], salt_by: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join ``small`` (one row a key, already written) to ``big``; null keys match nulls.

    ``small`` is counted: at most ``BROADCAST_ROWS`` rows are broadcast. Beyond, ``big`` is
    salted and ``small`` repeated for each salt, so a key with a third of all
    rows is spread over ``salts`` tasks. The salt comes from the columns
    ``salt_by``, so a task that runs again deals its rows out as before.
    """
    names = [f"_on{i}" for i in range(len(on))]
    right = small.select(*[F.col(c).alias(n) for c, n in zip(on, names, strict=True)], *[c for c in small.columns if c not in on])
    same = reduce(lambda a, b: a & b, [big[c].eqNullSafe(right[n]) for c, n in zip(on, names, strict=True)])
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), same, how).drop(*names)
    salted = big.withColumn("_salt", sliced(salts, *[F.col(c) for c in salt_by], seed=7))
    right = right.withColumn("_salt_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    same = reduce(lambda a, b: a & b, [salted[c].eqNullSafe(right[n]) for c, n in zip(on, names, strict=True)])
    return salted.join(right, same & (salted["_salt"] == right["_salt_of"]), how).drop("_salt", "_salt_of", *names)


#: Bits of a row's number that tell its place in its file, and those that tell it within a block of rows.
PLACE_BITS, BLOCK_BITS = 36, 17


def numbered(docs: DataFrame, columns: dict[str, str], name: str = "_row") -> DataFrame:
    """``columns`` (their names: new ones) of ``docs`` with a number of each row's own: its file in the high bits, its place in the file in the low ones.

    Both are properties of the files, so two scans number rows alike however
    Spark splits the files, with executors that join or leave in between. A
    table that isn't read from Parquet files is written first. What is
    broadcast is a row a file.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in columns.items()], meta["file_path"].alias("_file"), meta["row_index"].alias("_at"))
        rows.schema  # noqa: B018 - resolves the columns
    except AnalysisException:
        return numbered(written(docs, "numbered"), columns, name)
    paths = rows.select("_file").distinct()
    paths = written(paths.select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_k")), "file-numbers")
    rows = rows.join(F.broadcast(paths), "_file")
    return rows.select(*columns.values(), F.shiftleft("_k", PLACE_BITS).bitwiseOR(F.col("_at")).alias(name))


def mark_rows(rows: DataFrame, name: str = "_row", payload: str | None = None, keep: bool = False) -> str:
    """Write the numbers in ``rows``, with ``payload`` the 16 bytes beside each, as a file for each block of 2^BLOCK_BITS rows they come from; the folder.

    A task that runs again writes the same file.
    """
    folder = new_path(rows.sparkSession, "marked-rows", keep)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def put() -> None:
            if held:
                files.replace(f"{folder}/{part}", b"".join([*(n for n, _ in held), *(p for _, p in held)]))

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            parts = numbers >> BLOCK_BITS
            for p in np.unique(parts).tolist():
                if p != part:
                    put()
                    part, held = p, []
                a, b = np.searchsorted(parts, [p, p + 1])
                held.append((numbers[a:b].astype("<i8").tobytes(), b"".join(batch.column(1)[a:b].to_pylist()) if payload else b""))
        put()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    dealt = rows.select(F.col(name).cast("long").alias(name), *([payload] if payload else [])).repartition(F.shiftright(name, BLOCK_BITS)).sortWithinPartitions(name)
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder


class Marked:
    """What ``mark_rows`` wrote, looked up by row; a block's file is read once by a task that reads its rows."""

    def __init__(self, folder: str, width: int = 0):
        self.folder, self.width, self.part = folder, width, None
        self.numbers, self.payload = np.zeros(0, np.int64), b""

    def _turn_to(self, part: int) -> None:
        if part != self.part:
            data = files.read_if_there(f"{self.folder}/{part}")
            n = len(data) // (8 + self.width)
            self.part, self.numbers, self.payload = part, np.frombuffer(data, "<i8", n), data[8 * n :]

    def among(self, numbers: np.ndarray) -> np.ndarray:
        """Which of the rows are there."""
        out = np.zeros(len(numbers), bool)
        parts = numbers >> BLOCK_BITS
        for part in np.unique(parts).tolist():
            self._turn_to(part)
            own = np.flatnonzero(parts == part)
            if len(self.numbers):
                at = np.minimum(np.searchsorted(self.numbers, numbers[own]), len(self.numbers) - 1)
                out[own] = self.numbers[at] == numbers[own]
        return out

    def payloads(self, number: int) -> set[bytes]:
        """What is written beside a row."""
        self._turn_to(number >> BLOCK_BITS)
        a, b = np.searchsorted(self.numbers, [number, number + 1]).tolist() if len(self.numbers) else (0, 0)
        return {self.payload[k * self.width : (k + 1) * self.width] for k in range(a, b)}


def only_marked(docs: DataFrame, folder: str, name: str = "_row") -> DataFrame:
    """The rows of numbered ``docs`` that ``mark_rows`` wrote; nothing is shuffled."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = Marked(folder)
        for batch in batches:
            kept = marked.among(batch.column(batch.schema.get_field_index(name)).to_numpy())
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(read, docs.schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
