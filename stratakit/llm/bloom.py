"""Two Bloom filters over many hashes, for those seen once and those seen twice, in slices that are files of the shared folder.

Each task deals its hashes out by slice. A slice's owner puts each into the first
filter or, if that holds it, into the second. Filters grow with the number of
hashes; tasks read the slices of the second as they need them, and the driver
holds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm import common, files

#: Bits of a filter for each hash, of a slice of it (512 KB), the fewest slices, and probes for a hash.
HASH_BITS, SLICE_BITS, LEAST_SLICES, PROBES = 12, 1 << 22, 64, 4
#: Slices that a task holds at once.
HELD_SLICES = 128


def slices_for(n: int) -> int:
    """Enough slices for n hashes, a power of two."""
    return max(LEAST_SLICES, 1 << (-(-n * HASH_BITS // SLICE_BITS) - 1).bit_length())


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash, by its top bits."""
    return (hashes >> np.uint64(65 - slices.bit_length())).astype(np.int64)


def probes(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash within its slice, ``PROBES`` columns."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(26)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * high[:, None]) % np.uint64(SLICE_BITS)).astype(np.int64)


class Bits:
    """One slice of a filter; one made from bytes is only read."""

    def __init__(self, data: bytes | None = None):
        self.words = np.frombuffer(data, np.uint8) if data else np.zeros(SLICE_BITS // 8, np.uint8)

    def holds(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def add(self, at: np.ndarray) -> None:
        np.bitwise_or.at(self.words, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())


def dealt(hashes: np.ndarray, n_slices: int) -> pa.RecordBatch:
    """Hashes (unsigned 64 bits) as rows (slice, hashes), sorted."""
    hashes = np.sort(hashes)
    slices, first = np.unique(slice_of(hashes, n_slices), return_index=True)
    parts = np.split(hashes, first[1:])
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([p.tobytes() for p in parts if len(p)], pa.binary())], names=["slice", "hashes"])


DEALT = "slice int, hashes binary"


def _twice(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the slices that a task owns of the second filter; rows come slice by slice."""
    now, seen, again = None, Bits(), Bits()

    def put() -> None:
        if now is not None and again.words.any():
            files.replace(f"{folder}/{now}", again.words.tobytes())

    for batch in batches:
        for s, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if s != now:
                put()
                now, seen, again = s, Bits(), Bits()
            hashes = np.frombuffer(data.as_py(), np.uint64)
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]])  # sorted: a repeat within the row stands beside its first
            again.add(probes(hashes[~first]))
            at = probes(hashes[first])
            again.add(at[seen.holds(at)])
            # Two new hashes of a row may share bits; marking them twice only lets more through.
            seen.add(at)
    put()
    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])


def seen_twice(hashes: DataFrame) -> str:
    """The folder of the second filter, a file for each slice that holds anything; ``hashes`` are rows made by ``dealt``."""
    folder = common.new_path(hashes.sparkSession, "seen-twice")
    hashes.repartition("slice").sortWithinPartitions("slice").mapInArrow(lambda b: _twice(b, folder), "n long").agg(F.sum("n")).first()
    return folder


class Twice:
    """The second filter as a task reads it: what it lacks was seen once at most."""

    def __init__(self, folder: str, n_slices: int):
        self.folder, self.n_slices = folder, n_slices
        self.held: dict[int, Bits | None] = {}

    def _at(self, s: int) -> Bits | None:
        if s not in self.held:
            if len(self.held) >= HELD_SLICES:
                self.held.pop(next(iter(self.held)))
            data = files.read_if_there(f"{self.folder}/{s}")
            self.held[s] = Bits(data) if data else None
        return self.held[s]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        if len(hashes):
            slices, at = slice_of(hashes, self.n_slices), probes(hashes)
            order = np.argsort(slices, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(slices[order])) + 1):
                if (bits := self._at(int(slices[own[0]]))) is not None:
                    out[own] = bits.holds(at[own])
        return out
