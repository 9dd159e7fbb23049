"""Token ids as binary shards with Elias-Fano document boundaries.

A shard file holds the concatenated ids of consecutive documents as a little-
endian array (16 bits an id where the vocabulary allows) and two Elias-Fano
sequences: the document boundaries in the array and the ascending document ids.
A sequence of n values below u takes n * (2 + log2(u / n)) bits; ``select`` finds
any value through sampled positions of one bits.

    magic "STKTOKS1" | bytes an id u32 | null ids u64 | ids u64 | least doc id i64
    | length u64, boundaries | length u64, document ids | ids
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratakit.llm import common, files

MAGIC, HEAD = b"STKTOKS1", struct.Struct("<8sIQQq")
#: The id that ends every document.
END_ID = 0
#: Ids after which a task begins another shard; a longer document has a shard for itself.
SHARD_IDS = 1 << 22
#: Words of a generation whose ids a worker remembers.
CACHE_WORDS = 400_000
VOCABULARY = "byte_bpe_50k.json"


class EliasFano:
    """An ascending sequence of non-negative integers in near minimal space."""

    SAMPLE = 256
    FORM = struct.Struct("<QQB")

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n, low_bits), np.uint8)
        for b in range(low_bits):
            low[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[:: cls.SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return self.FORM.pack(self.n, len(self.high), self.low_bits) + self.samples.astype("<u4").tobytes() + self.high + self.low

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, high, low_bits = cls.FORM.unpack_from(data)
        at = cls.FORM.size
        samples = np.frombuffer(data, "<u4", -(-n // cls.SAMPLE), at)
        at += samples.nbytes
        return cls(n, low_bits, data[at + high :], data[at : at + high], samples)

    def _places(self, k: int) -> np.ndarray:
        """Where the ones of the k-th run of ``SAMPLE`` stand."""
        first = int(self.samples[k])
        last = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, -(-last // 8) - first // 8, first // 8), bitorder="little")
        ones = np.flatnonzero(bits) + (first - first % 8)
        return ones[ones >= first][: min(self.SAMPLE, self.n - k * self.SAMPLE)]

    def run(self, k: int) -> np.ndarray:
        """The k-th ``SAMPLE`` values, selected from the run of ones that the samples point to; nothing else is decoded."""
        ones, first = self._places(k), k * self.SAMPLE
        out = (ones - np.arange(first, first + len(ones))) << self.low_bits
        if self.low_bits:
            start, end = first * self.low_bits, (first + len(ones)) * self.low_bits
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8, -(-end // 8) - start // 8, start // 8), bitorder="little")
            low = bits[start % 8 : start % 8 + end - start].reshape(-1, self.low_bits).astype(np.int64)
            out |= low @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.run(i // self.SAMPLE)[i % self.SAMPLE])

    def cursor(self) -> Iterator[int]:
        """All values in order, a run at a time."""
        for k in range(len(self.samples)):
            yield from self.run(k).tolist()


class Encoder:
    """Whole texts to ids, as bytes, by the tokenizers library.

    A byte-level BPE without normaliser never joins characters across a single
    space or line feed between two that are not white space. For such a
    vocabulary a text is parted there, the library encodes each word that a
    worker doesn't remember once, with the space or line feed before it, and the
    ids are put together again; the result equals that of the whole text. A text
    that holds the string of an added token is encoded in one piece.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        feed = self._ids("\n")
        self.parted = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and len(feed) == 1
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids of a line feed, or of a space with what follows
        self.begins[[int(feed[0]), *[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]]] = True
        # Ids of words after a space, and of a line feed with the word after it. The older of two generations goes when the younger is full.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, words: set[str]) -> dict[str, bytes] | None:
        """The remembered ids, these words among them; new ones are encoded together. None if a word is empty or holds other white space."""
        missing = words.difference(self.young)
        if len(self.young) + len(missing) > CACHE_WORDS and self.young:
            self.old, self.young = self.young, {}
            missing = words
        if self.old:
            again, missing = missing, missing.difference(self.old)  # a set's intersection with a dictionary would go through all of that
            again = again - missing
            self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        if missing:
            new = list(missing)
            glued = "".join([w if w[:1] == "\n" else f" {w}" for w in new])
            bare = glued.split()
            if len(bare) != len(new) or len(glued) - sum(map(len, bare)) != len(new):
                return None
            ids = self._ids(glued)
            cuts = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * ids.itemsize
            self.young.update(zip(new, map(ids.tobytes().__getitem__, map(slice, cuts[:-1].tolist(), cuts[1:].tolist())), strict=True))
        return self.young

    def encode(self, text: str) -> bytes:
        if not self.parted or any(x in text for x in self.added):
            return self._ids(text).tobytes()
        words = f"\n{text}".replace("\n", " \n").split(" ")[1:]
        known = self._learn(set(words))
        if known is None:
            return self._uneven(text)
        return b"".join(map(known.__getitem__, words))[int(self.kind[2]) :]

    def _uneven(self, text: str) -> bytes:
        """A text with other white space, or more of it in a row: that stays with the words beside it."""
        first, *rest = self.CUT.split(text)
        spaced = self._learn({w for w in rest if len(w.split()) == 1 and not (w[0].isspace() or w[-1].isspace())}) or {}
        return b"".join([self._ids(first).tobytes(), *[spaced[w] if w in spaced else self._ids(" " + w).tobytes() for w in rest]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder of a vocabulary file, loaded once."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def shard_bytes(doc_ids: list[int | None], docs: list[bytes], kind: str) -> bytes:
    """A shard of documents in ascending order of id, null ids first."""
    width = int(kind[2])
    ends = np.cumsum([0] + [len(d) // width for d in docs])
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds, ids = EliasFano.of(ends).to_bytes(), EliasFano.of((known - least).astype(np.uint64)).to_bytes()
    head = HEAD.pack(MAGIC, width, len(doc_ids) - len(known), int(ends[-1]), least)
    return b"".join([head, struct.pack("<Q", len(bounds)), bounds, struct.pack("<Q", len(ids)), ids, *docs])


def read_shard(data: bytes) -> tuple[int, int, EliasFano, EliasFano, np.ndarray]:
    """Of a shard: how many ids are null, the least id, the others above it, the boundaries, and the id array."""
    magic, width, nulls, n_ids, least = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, found = HEAD.size, []
    for _ in range(2):
        (n,) = struct.unpack_from("<Q", data, at)
        found.append(EliasFano.from_bytes(data[at + 8 : at + 8 + n]))
        at += 8 + n
    return nulls, least, found[1], found[0], np.frombuffer(data, f"<u{width}", n_ids, at)


def shard_documents(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset, ids) of a shard's documents in order; offsets are selected from the encoded boundaries, not decoded into a table."""
    nulls, least, doc_ids, bounds, array = read_shard(data)
    known = (least + i for i in doc_ids.cursor())
    for k, (a, b) in enumerate(pairwise(bounds.cursor())):
        yield None if k < nulls else next(known), a, array[a:b]


def _shards(batches: Iterable[pa.RecordBatch], folder: str, path: str, most: int) -> Iterator[pa.RecordBatch]:
    code, end = encoder(path), None
    end = np.array([END_ID], code.kind).tobytes()
    ids: list[int | None] = []
    docs: list[bytes] = []
    size, seq = 0, 0

    def flush() -> pa.RecordBatch:
        name = f"{folder}/{files.attempt_name('tokens', seq)}.tok"
        with files.create(name) as f:
            f.write(shard_bytes(ids, docs, code.kind))
        row = {"part": TaskContext.get().partitionId(), "seq": seq, "path": name, "n_docs": len(ids), "n_ids": size}
        return pa.RecordBatch.from_pylist([row], SHARD_ROW)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = code.encode(text.as_py() or "") + end
            n = len(got) // len(end)
            if docs and size + n > most:
                yield flush()
                ids, docs, size, seq = [], [], 0, seq + 1
            ids.append(doc_id)
            docs.append(got)
            size += n
    if docs:
        yield flush()


SHARD_ROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode every whole text (null: empty) and write the shards; their manifest, in ascending order of doc_id.

    Texts are range-partitioned by id (and by text where ids repeat). The
    manifest has a row a shard: path, documents, ids and ``start``, the ids of
    all shards before it.
    """
    spark = docs.sparkSession
    folder = common.new_path(spark, "token-shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    most = SHARD_IDS
    shards = common.written(rows.mapInArrow(lambda b: _shards(b, folder, vocabulary, most), "part int, seq int, path string, n_docs long, n_ids long"), "token-manifest")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select(F.col("part").alias("_part"), before(Window.orderBy("part")).alias("_before"))
    own = shards.withColumn("_own", before(Window.partitionBy("part").orderBy("seq")))
    placed = own.join(parts, own["part"] == parts["_part"])
    return common.written(placed.select(*shards.columns, (F.col("_before") + F.col("_own")).alias("start")), "token-starts")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with files.opened(row["path"]) as f:
                got = [(doc_id, row["start"] + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, a, ids in shard_documents(f.read())]
            columns = [pa.array(c, pa.int64()) for c in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row a document from the shard files: its id, place in the whole array, length and checksum of ids."""
    n = manifest.count()
    return manifest.select("path", "start").repartition(max(1, min(n, 10_000)), "path").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


@common.staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: write the shards of all rows (repeated ones too) and read them back.

    Null ids come first; null and empty texts have the end id alone; a longer
    text than a shard has one for itself; an empty table gives an empty result;
    other columns than doc_id and text are not read.
    """
    return read_tokens(write_tokens(docs, public_tokenizers.path(VOCABULARY)))


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, repeated ones too; null ids come first; a text that is null or empty has the end id alone; a text of any length is encoded whole; an empty table gives an empty result."""
    return read_tokens(write_tokens(common.documents(spark, sf_dir), public_tokenizers.path(VOCABULARY)))
