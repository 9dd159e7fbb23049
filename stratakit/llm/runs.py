"""Periodic runs of words: branching tandem repeats from a suffix tree, rotated and merged into maximal runs.

The suffix trees of many texts are built at once: their suffixes are sorted by
doubling, a key never being shared by two texts, and the inner nodes are the
intervals of the common prefix lengths. At each node the leaves of all children
but the largest are visited (smaller-half traversal): leaf i of a node whose
path has D words starts a branching tandem repeat if i + D is a leaf of another
child, and ends one if i - D is. A run's last repeat is branching; rotating it to
the left as far as words agree gives the run's start. Repeats whose period is a
multiple of one that ends the same run merge with it.

All of a text's work is done in one task; many texts are held at a time up to a
number of words, and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import common

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words of texts that are searched together, and leaves that are visited together.
HELD_WORDS, HELD_LEAVES = 1 << 18, 1 << 21

Words = list[bytes]
Run = tuple[int, int, int]


def suffixes(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of texts that share no key, and the ranks of suffixes by their first 1, 2, 4, ... keys; the last ranks have no two alike.

    ``ends`` tells for each place where its text ends. A suffix that ends sorts before those that go on.
    """
    n = len(keys)
    order = np.argsort(keys)
    found, at, h = keys[order], np.arange(n), 1
    rank, levels = np.empty(n, np.int64), []
    while True:
        first = np.ones(len(at), bool)
        first[1:] = found[1:] != found[:-1]
        here = order[at]
        rank[here] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        levels.append(rank.astype(np.int32))
        alone = first.copy()
        alone[:-1] &= first[1:]
        at = at[~alone]
        if not len(at):
            return order, levels
        here = order[at]
        ahead = here + h
        behind = np.where(ahead < ends[here], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[here] * (n + 1) + behind
        dealt = np.argsort(key)
        order[at], found = here[dealt], key[dealt]
        h *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places b where suffixes order[b - 1] and order[b] share a prefix, and its length."""
    ranked = levels[0][order]
    at = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    a, b = order[at - 1], order[at]
    length, last = np.zeros(len(at), np.int64), len(order) - 1
    for k in reversed(range(len(levels))):
        i, j = a + length, b + length
        alike = (i < ends[a]) & (j < ends[b])
        alike &= levels[k][np.minimum(i, last)] == levels[k][np.minimum(j, last)]
        length[alike] += 1 << k
    return at, length


def inner_nodes(at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place where suffixes share a prefix the interval (from, to) of the suffix array that shares as much: one node of the suffix tree."""
    m = len(at)
    start, stop, places, depths = [0] * m, [0] * m, at.tolist(), length.tolist()
    path: list[int] = []
    base, last = 0, -2
    for k, (b, d) in enumerate(zip(places, depths, strict=True)):
        if b != last + 1:
            for x in path:
                stop[x] = last + 1
            path, base = [], b - 1
        while path and depths[path[-1]] > d:
            stop[path.pop()] = b
        if not path:
            start[k] = base
        else:
            start[k] = start[path[-1]] if depths[path[-1]] == d else places[path[-1]]
        path.append(k)
        last = b
    for x in path:
        stop[x] = last + 1
    return np.array(start, np.int64), np.array(stop, np.int64)


def branching_repeats(order: np.ndarray, levels: list[np.ndarray], begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of every tandem repeat that the next word does not continue."""
    at, length = common_prefixes(order, levels, ends)
    if not len(at):
        return at, length
    start, stop = inner_nodes(at, length)
    n, place = len(order), levels[-1]
    by_node = np.argsort(start * (n + 1) + stop, kind="stable")
    cut, lo, hi, depth = at[by_node], start[by_node], stop[by_node], length[by_node]
    head = np.ones(len(cut), bool)
    head[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    heads = np.flatnonzero(head)
    # Children of a node: from its start to the first cut, then from each cut to the next or the node's end.
    after = np.append(cut[1:], 0)
    tail = np.append(head[1:], True)
    after[tail] = hi[tail]
    node = np.cumsum(head) - 1
    child_lo, child_hi = np.insert(cut, heads, lo[heads]), np.insert(after, heads, cut[heads])
    of = np.insert(node, heads, node[heads])
    size = child_hi - child_lo
    most = np.maximum.reduceat(size, heads + np.arange(len(heads)))
    largest = np.flatnonzero(size == most[of])
    largest = largest[np.append(True, of[largest][1:] != of[largest][:-1])]
    small = np.ones(len(size), bool)
    small[largest] = False
    child_lo, child_hi, of, size = child_lo[small], child_hi[small], of[small], size[small]
    lo, hi, depth = lo[heads], hi[heads], depth[heads]
    starts, halves = [], []
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HELD_LEAVES, "right")))
        k = np.repeat(np.arange(a, b), size[a:b])
        leaf = np.arange(len(k)) - np.repeat(total[a:b] - size[a:b] - (total[a - 1] if a else 0), size[a:b]) + child_lo[k]
        i, d, v = order[leaf], depth[of[k]], of[k]
        for j, there in ((i + d, i + d < ends[i]), (i - d, i - d >= begins[i])):
            r = place[np.where(there, j, 0)]
            found = there & (r >= lo[v]) & (r < hi[v]) & ((r < child_lo[k]) | (r >= child_hi[k]))
            starts.append(np.minimum(i, j)[found])
            halves.append(d[found])
        a = b
    pairs = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(halves))
    return pairs // (n + 1), pairs % (n + 1)


def rotated(keys: np.ndarray, begin: int, i: int, period: int) -> int:
    """The least start of a stretch with this period that goes on at i."""
    step = 16
    while i > begin:
        lo = max(begin, i - step)
        if len(other := np.flatnonzero(keys[lo:i] != keys[lo + period : i + period])):
            return lo + int(other[-1]) + 1
        i, step = lo, 2 * step
    return begin


def runs_of(texts: list[Words]) -> list[list[Run]]:
    """(start, length, period) of the maximal runs of each text, by start, then period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    n, out = int(sizes.sum()), [[] for _ in texts]
    if not n:
        return out
    known: dict[bytes, int] = defaultdict(lambda: len(known))
    ids = np.fromiter((known[w] for words in texts for w in words), np.int64, n)
    stops = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    begins, ends = (stops - sizes)[text], stops[text]
    keys = text * len(known) + ids
    start, half = branching_repeats(*suffixes(keys, ends), begins, ends)
    # Only repeats that go on to the left as long as a run must can be the last of one.
    far = start + 2 * half - np.maximum(MIN_WORDS, MIN_PERIODS * half)
    enough = far >= begins[start] if len(start) else np.zeros(0, bool)
    start, half, far = start[enough], half[enough], far[enough]
    alike = (keys[far] == keys[far + half]) & (keys[start - 1] == keys[start - 1 + half])
    start, half = start[alike], half[alike]
    merged: tuple[int, list[tuple[int, int]]] = (-1, [])
    for k in np.lexsort((half, start + 2 * half)).tolist():
        i, p = int(start[k]), int(half[k])
        end = i + 2 * p
        if merged[0] != end:
            merged = (end, [])
        if any(p % q == 0 and first <= i for q, first in merged[1]):
            continue
        begin = int(begins[i])
        first = rotated(keys, begin, i, p)
        merged[1].append((p, first))
        if end - first >= max(MIN_WORDS, MIN_PERIODS * p):
            out[int(text[i])].append((first - begin, end - first, p))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: Words, runs: list[Run]) -> bytes:
    """The words that stay, joined by one space: each run keeps its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()])


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_runs(docs: DataFrame, rewrite: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row of ``docs`` (doc_id, text): its maximal runs of words and what stays, words joined by one space.

    ``rewrite`` may change a text's words first. A null or empty text has no
    words, no runs and an empty text; a text of any length is searched whole, in
    memory that grows as its words times the logarithm of its longest repeat;
    repeated rows are searched each by itself; an empty table gives an empty
    result; other columns are not read.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[Words] = []
        held = 0

        def found() -> pa.RecordBatch:
            runs = runs_of(texts)
            rows = [[{"start": a, "length": m, "period": p} for a, m, p in r] for r in runs]
            left = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), pa.array(rows, _RUNS), left], names=["doc_id", "n_words", "runs", "text"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()
                ids.append(doc_id)
                texts.append(rewrite(doc_id, words) if rewrite else words)
                held += len(words)
                if held >= HELD_WORDS:
                    yield found()
                    ids, texts, held = [], [], 0
        if ids:
            yield found()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, SCHEMA)


def planted(doc_id: int | None, words: Words) -> Words:
    """The words of a tenth of all documents made periodic from some word on; the crc32 of the id (of nothing, for a null id) decides."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + period]
    return words[:a] + (once * -(-(n - a) // period))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, by ``collapse_runs`` on words that ``planted`` has changed; a null id counts as an empty one there, null and empty texts have no words."""
    rows = collapse_runs(common.documents(spark, sf_dir), planted)
    best = F.expr("aggregate(runs, runs[0], (m, r) -> IF(r.length * m.period > m.length * r.period, r, m))")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
        "n_words",
    )
