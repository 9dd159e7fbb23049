"""Line dedup with two Bloom filters; only suspected repeats are shuffled for exact confirmation.

First pass: each task hashes its distinct (document, key) pairs for the filters
of hashes seen once and seen twice (``bloom``), which grow with the number of
lines.

Second pass: lines whose hash is in the second filter are suspects. Their keys,
as 128-bit digests, are counted over distinct documents; keys in ``MIN_DOCS`` or
more keep their lines in the largest doc_id alone. Third pass: the lines go. What
each block of rows loses lies in a file beside it, so texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import bloom, common

MIN_CHARS, MIN_DOCS = 20, 3
#: Hashes a task holds before it sends them on.
HELD_HASHES = 1 << 20


def key_of(line: bytes) -> bytes | None:
    """A line's key, or None for one too short to count; on UTF-8, white space and A-Z as in the contract."""
    key = line.strip(b" \t\n\x0b\f\r")
    if len(key) < MIN_CHARS:
        return None
    key = key.translate(common.FOLD)
    return key if len(key) >= 4 * MIN_CHARS or len(key.decode()) >= MIN_CHARS else None


def slices_for(docs: DataFrame) -> int:
    """Enough slices for all lines of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    return bloom.slices_for(docs.agg(F.sum(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)).first()[0] or 0)


def _texts(batch: pa.RecordBatch, i: int) -> Iterator[bytes]:
    for text in batch.column(i).cast(pa.binary()):
        yield text.as_py() or b""


def _hashes(batches: Iterator[pa.RecordBatch], n_slices: int) -> Iterator[pa.RecordBatch]:
    """Hashes of each document's distinct keys, by slice."""
    held: list[int] = []
    for batch in batches:
        for text in _texts(batch, 0):
            held.extend({xxhash.xxh3_64_intdigest(k) for line in text.split(b"\n") if (k := key_of(line)) is not None})
            if len(held) >= HELD_HASHES:
                yield bloom.dealt(np.array(held, np.uint64), n_slices)
                held = []
    if held:
        yield bloom.dealt(np.array(held, np.uint64), n_slices)


def seen_twice(docs: DataFrame) -> tuple[str, int]:
    """The folder of the second filter and the number of its slices."""
    n = slices_for(docs)
    return bloom.seen_twice(docs.select("text").mapInArrow(lambda b: _hashes(b, n), bloom.DEALT)), n


def suspects(docs: DataFrame, twice: tuple[str, int]) -> DataFrame:
    """(row, doc_id, key) of the distinct suspected keys of every row; ``key`` is a 128-bit digest."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = bloom.Twice(*twice)
        for batch in batches:
            at_row, keys, hashes = [], [], []
            for i, text in enumerate(_texts(batch, 2)):
                for k in {k for line in text.split(b"\n") if (k := key_of(line)) is not None}:
                    at_row.append(i)
                    keys.append(k)
                    hashes.append(xxhash.xxh3_64_intdigest(k))
            kept = np.flatnonzero(again.holds(np.array(hashes, np.uint64)))
            rows = pa.array(np.array(at_row, np.int64)[kept])
            digests = [hashlib.blake2b(keys[i], digest_size=16).digest() for i in kept.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(digests, pa.binary())], names=["row", "doc_id", "key"])

    return docs.select("row", "doc_id", "text").mapInArrow(found, "row long, doc_id long, key binary")


def drops(docs: DataFrame) -> str:
    """The folder of the keys that each row of ``docs`` (row, doc_id, text) loses, by ``common.mark_rows``. Null ids count as one document, less than all others.

    The join is with a written table: Spark broadcasts it while it is small,
    else it splits the rows of a line that a large share of all documents hold.
    """
    with common.scope():
        suspected = common.written(suspects(docs, seen_twice(docs)), "suspects")
        holders = suspected.select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("_docs"), F.max("doc_id").alias("_last"))
        repeated = common.written(holders.filter(F.col("_docs") >= MIN_DOCS).drop("_docs"), "repeated-keys")
        lost = suspected.join(repeated, "key").filter(~F.col("doc_id").eqNullSafe(F.col("_last")))
        return common.mark_rows(lost, "row", payload="key", keep=True)


def _cut(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Each document after its lines went."""
    lost = common.Marked(folder, 16)
    for batch in batches:
        out = []
        for row, text in zip(batch.column(0).to_pylist(), _texts(batch, 2), strict=True):
            lines, rest = text.split(b"\n"), None
            if gone := lost.payloads(row):
                rest = [line for line in lines if (k := key_of(line)) is None or hashlib.blake2b(k, digest_size=16).digest() not in gone]
            rest = lines if rest is None else rest
            out.append((len(lines), len(lines) - len(rest), b"\n".join(rest)))
        n, dropped, texts = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every row of ``docs``, read from files, with its text after repeated lines went.

    A null or empty text is one empty line. Rows that share a doc_id are one
    document: a key in any of them counts once, and they lose the same keys. A
    text of any length is read whole. An empty table gives an empty result;
    other columns are not read.
    """
    docs = common.numbered(docs, {"doc_id": "doc_id", "text": "text"}, "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = drops(docs)
    return docs.mapInArrow(lambda b: _cut(b, folder), "doc_id long, n_lines long, n_dropped long, text string")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, by ``dedup_lines``: null and empty texts are one empty line, null ids one document, repeated rows stay rows of their own."""
    return dedup_lines(common.documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""
