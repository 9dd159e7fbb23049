"""Exact substring dedup: suffix arrays of shards by induced sorting, common prefixes in text order.

A byte goes if a string of ``LENGTH`` bytes around it also starts earlier. Strings
that are equal have the same least hash of their ``GRAM``-byte parts, so a text is
cut into segments, each of the strings whose least part is one and the same; a
segment whose hash a filter has seen twice is written. Of equal segments the first
stands for all. The different segments of one hash are a group, many groups a
shard, whose suffix array shows which strings of them are equal. A group of very
many is first split by how far before the least part strings start.

The suffix arrays of a shard's groups are built side by side: suffixes are classed
as smaller or larger than the next, leftmost-smaller substrings are sorted by
inducing, named, sorted recursively where names repeat, and induce the rest. One
step of the inducing scan is done for all groups at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import bloom, common

#: Bytes of a string, and of the parts whose least hash groups it.
LENGTH, GRAM = 100, 48
#: Parts of a string; a segment has so many strings at most.
PARTS = LENGTH - GRAM + 1
#: A group of more different segments is split. Symbols of a shard that are sorted together; hashes held by a task.
HOT, HELD_SYMBOLS, HELD_HASHES = 256, 1 << 19, 1 << 19
#: A segment of more copies is broadcast when copies are told from the first; those are at most one in so many of all.
COPIES = 10_000


def spread(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each ``lo`` on, ``n`` of them, and which of the stretches each is from."""
    of = np.repeat(np.arange(len(n)), n)
    return lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def sorted_suffixes(text: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The suffix arrays of strings that stand one after another in ``text``: lengths ``n``, symbols below ``kinds``; each ends with its only 0."""
    total, groups = len(text), len(n)
    off = np.cumsum(n) - n
    last, of = off + n - 1, np.repeat(np.arange(groups), n)
    bucket = (np.cumsum(kinds) - kinds)[of] + text
    here = np.arange(total)
    change = np.append(text[1:] != text[:-1], True)
    change[last] = True
    then = np.minimum.accumulate(np.where(change, here, total)[::-1])[::-1]
    smaller = (then == last[of]) | (text[then] < text[np.minimum(then + 1, total - 1)])
    leftmost = smaller.copy()
    leftmost[1:] &= ~smaller[:-1]
    leftmost[off] = False
    behind = np.append(False, smaller[:-1])
    inner = np.ones(total, bool)
    inner[off] = False
    # The last element is looked up for places not filled yet.
    from_larger, from_smaller = np.append(inner & ~behind, False), np.append(inner & behind, False)
    size = np.bincount(bucket, minlength=int(kinds.sum()))
    tails = np.cumsum(size)
    heads = tails - size
    longest = np.argsort(-n, kind="stable")
    first = off[longest]
    active = groups - np.searchsorted(n[longest][::-1], np.arange(int(n.max())), "right")

    def induced(order: np.ndarray) -> np.ndarray:
        out = np.full(total, -1)
        b = bucket[order]
        by = np.argsort(b, kind="stable")
        b, count = b[by], np.bincount(b, minlength=len(size))
        out[tails[b] - count[b] + np.arange(len(b)) - (np.cumsum(count) - count)[b]] = order[by]
        out[off] = last
        head, tail = heads.copy(), tails.copy()
        for s, k in enumerate(active.tolist()):
            p = out[first[:k] + s]
            j = p[from_larger[p]] - 1
            b = bucket[j]
            at = head[b]
            out[at] = j
            head[b] = at + 1
        for s in range(len(active) - 1, -1, -1):
            p = out[first[: active[s]] + s]
            j = p[from_smaller[p]] - 1
            b = bucket[j]
            at = tail[b] - 1
            out[at] = j
            tail[b] = at
        return out

    places = np.flatnonzero(leftmost)
    if not len(places):
        return induced(places)
    found = induced(places)
    found = found[leftmost[found]]
    number = np.zeros(total, np.int64)
    number[places] = np.arange(len(places))
    stop = np.append(places[1:], places[-1])
    stop = np.where(places == last[of[places]], places, stop)
    length = (stop - places + 1)[number[found]]
    own = of[found]
    alike = np.flatnonzero((length[1:] == length[:-1]) & (own[1:] == own[:-1]))
    new = np.ones(len(found), bool)
    if len(alike):
        left, pair = spread(found[alike], length[alike])
        right, _ = spread(found[alike + 1], length[alike])
        differ = np.bincount(pair, text[left] != text[right], len(alike)) > 0
        new[alike[~differ] + 1] = False
    if new.all():
        return induced(found)
    m = np.bincount(own, minlength=groups)
    m = m[m > 0]
    name = np.cumsum(new) - 1
    start = np.cumsum(m) - m
    names = name[start + m - 1] - name[start] + 1
    reduced = np.empty(len(found), np.int64)
    reduced[number[found]] = name - np.repeat(name[start], m)
    return induced(places[sorted_suffixes(reduced, m, names)])


def permuted_prefixes(text: np.ndarray, order: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place in ``text`` how long a prefix its suffix shares with the one before it in ``order``, from left to right in every string at once."""
    off = np.cumsum(n) - n
    before = np.full(len(text), -1)
    before[order[1:]] = order[:-1]
    before[order[off]] = -1
    out = np.zeros(len(text), np.int64)
    at, ends, shared = off.copy(), off + n, np.zeros(len(n), np.int64)
    while len(at):
        f = before[at]
        same = (f >= 0) & (text[at + shared] == text[f + shared])
        shared += same
        done = ~same
        out[at[done]] = shared[done]
        at = at + done
        shared = np.maximum(shared - done, 0)
        going = at < ends
        if not going.all():
            at, ends, shared = at[going], ends[going], shared[going]
    return out


def part_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of every ``GRAM`` bytes: of twice as many bytes at each step, the last of 32 and 16."""
    h, by = text.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15), {}
    for k, factor in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93), (8, 0xA0761D6478BD642F), (16, 0xE7037ED1A0B428DB)):
        by[k] = h
        h = h[:-k] * np.uint64(factor) + h[k:]
        h ^= h >> np.uint64(29)
    h = h[: len(h) - 16] * np.uint64(0x8EBC6AF09C88C6E3) + by[16][32:]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(31))


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, strings) of the segments: strings in a row whose least part, of equals the last, is at one place."""
    if len(text) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = part_hashes(np.frombuffer(text, np.uint8))
    least, k = hashes, 1
    while 2 * k <= PARTS:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < PARTS:
        least = np.minimum(least[: len(least) - (PARTS - k)], least[PARTS - k :])
    start = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (hashes[PARTS:] == least[1:])))
    # Least hashes are small; mixed anew they are spread over all numbers again.
    h = (least[start] ^ (least[start] >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33)), start, np.diff(np.append(start, len(least)))


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def _hashes(batches: Iterator[pa.RecordBatch], n_slices: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        for text in _texts(batch.column(0)):
            held.append(segments(text)[0])
            n += len(held[-1])
            if n >= HELD_HASHES:
                yield bloom.dealt(np.concatenate(held), n_slices)
                held, n = [], 0
    if n:
        yield bloom.dealt(np.concatenate(held), n_slices)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _pair(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    columns = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if t == "binary" else pa.int64()) for c, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[c for c, _ in columns])


SUSPECT = "h long, d long, row long, doc_id long, start long, n long"


def suspects(docs: DataFrame) -> DataFrame:
    """The segments of ``docs`` (row, doc_id, text) whose hash ``h`` was seen twice, with a digest ``d`` of their bytes: h and d tell segments apart."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = bloom.slices_for(size * 2 // PARTS)
    folder = bloom.seen_twice(docs.select("text").mapInArrow(lambda b: _hashes(b, n_slices), bloom.DEALT))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = bloom.Twice(folder, n_slices)
        for batch in batches:
            texts = list(_texts(batch.column(2)))
            cut = [segments(t) for t in texts]
            kept = again.holds(np.concatenate([c[0] for c in cut])) if cut else np.zeros(0, bool)
            at, held = 0, []
            for row, doc_id, text, (h, start, n) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, cut, strict=True):
                own = np.flatnonzero(kept[at : at + len(h)])
                at += len(h)
                held.extend((k, _digest(text[s : s + m - 1 + LENGTH]), row, doc_id, s, m) for k, s, m in zip(h[own].view(np.int64).tolist(), start[own].tolist(), n[own].tolist(), strict=True))
                if len(held) >= 50_000:
                    yield _batch(held, SUSPECT)
                    held = []
            if held:
                yield _batch(held, SUSPECT)

    return docs.select("row", "doc_id", "text").mapInArrow(found, SUSPECT)


SEGMENT = "h long, d long, known long, doc_id long, row long, start long, n long, seg binary"


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` segments (h, d, row, start, n) of ``docs`` with their bytes, read from the texts again."""
    bytes_of = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("h", "d", "start", "n")])
    folder = common.mark_rows(wanted.select("row", bytes_of.alias("key")), "row", payload="key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = common.Marked(folder, 32)
        for batch in batches:
            held = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                if own := marked.payloads(row):
                    data = text.as_py()
                    for key in own:
                        h, d, start, n = (int.from_bytes(key[k : k + 8], "big", signed=True) for k in (0, 8, 16, 24))
                        held.append((h, d, int(doc_id is not None), doc_id, row, start, n, data[start : start + n - 1 + LENGTH]))
                if len(held) >= 20_000:
                    yield _batch(held, SEGMENT)
                    held = []
            if held:
                yield _batch(held, SEGMENT)

    return docs.select("row", "doc_id", "text").mapInArrow(read, SEGMENT)


def later_strings(groups: list[list[tuple]]) -> list[int]:
    """For each segment (known, doc_id, row, start, n, seg) of the groups, as bits, its strings that also start earlier in the group."""
    parts, n, kinds, begins = [], [], [], []
    total = 0
    for rows in groups:
        m = len(rows)
        for k, r in enumerate(rows):
            begins.append(total)
            parts.append(np.append(np.frombuffer(r[5], np.uint8).astype(np.int64) + m + 1, k + 1))
            total += len(r[5]) + 1
        parts.append(np.zeros(1, np.int64))
        total += 1
        n.append(sum(len(r[5]) + 1 for r in rows) + 1)
        kinds.append(257 + m)
    text, lengths = np.concatenate(parts), np.array(n)
    order = sorted_suffixes(text, lengths, np.array(kinds))
    kind = np.empty(total, np.int64)
    kind[order] = np.cumsum(permuted_prefixes(text, order, lengths)[order] < LENGTH)
    rows = [r for g in groups for r in g]
    known, doc, row, start, count = (np.array([r[c] or 0 for r in rows], np.int64) for c in range(5))
    at, seg = spread(np.array(begins), count)
    i = at - np.array(begins)[seg]
    by = np.lexsort((start[seg] + i, row[seg], doc[seg], known[seg], kind[at]))
    later = by[1:][kind[at][by][1:] == kind[at][by][:-1]]
    out = np.zeros(len(rows), np.int64)
    np.add.at(out, seg[later], np.int64(1) << i[later])
    return out.tolist()


BITS = "h long, d long, bits long"
#: Segments or parts of them in groups (g1, g2) of those that can share strings; the first string is the ``shift``-th of the segment (h, d).
MEMBER = "g1 long, g2 long, h long, d long, shift long, known long, doc_id long, row long, start long, n long, seg binary"


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of members that come group by group."""
    groups: list[list[tuple]] = []
    keys: list[list[tuple[int, int, int]]] = []
    size, now = 0, None

    def solved() -> Iterator[pa.RecordBatch]:
        if many := [k for k, g in enumerate(groups) if len(g) > 1]:
            bits = later_strings([groups[k] for k in many])
            yield _batch([(h, d, b << shift) for (h, d, shift), b in zip([key for k in many for key in keys[k]], bits, strict=True)], BITS)

    for batch in batches:
        for g1, g2, h, d, shift, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (g1, g2) != now:
                if size >= HELD_SYMBOLS:
                    yield from solved()
                    groups, keys, size = [], [], 0
                groups.append([])
                keys.append([])
                now = g1, g2
            groups[-1].append(tuple(rest))
            keys[-1].append((h, d, shift))
            size += len(rest[-1]) + 1
    yield from solved()


#: A range of bytes before the least part is split into so many.
RANGES = 4
PART = f"{MEMBER}, lo long, hi long, c1 long, c2 long"


def least_place(seg: bytes) -> int:
    """Where a segment's least part stands."""
    hashes = part_hashes(np.frombuffer(seg, np.uint8))
    return len(hashes) - 1 - int(np.argmin(hashes[::-1]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (their strings start ``lo`` to ``hi`` bytes before the least part) in up to ``RANGES`` parts by where strings start.

    All strings of a range hold the least part, ``lo`` bytes before it and so many
    behind it that the last of the range has: parts that share a string are in one
    group. c1 and c2 tell the bytes of parts apart.
    """
    for batch in batches:
        out = []
        for _, _, h, d, shift, known, doc_id, row, start, n, seg, low, high in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            at = least_place(seg)
            width = -(-(high - low + 1) // RANGES)
            for lo in range(low, high + 1, width):
                hi = min(lo + width - 1, high)
                a, b = max(lo, at - n + 1), min(hi, at)  # own strings start so many bytes before
                if a <= b:
                    skip, m = at - b, b - a + 1
                    own = seg[skip : skip + m - 1 + LENGTH]
                    shared = seg[at - lo : at + LENGTH - hi]
                    out.append((*_pair(b"%d %d " % (lo, hi) + shared), h, d, shift + skip, known, doc_id, row, start + skip, m, own, lo, hi, *_pair(b"%d %d %d " % (lo, hi, b) + own)))
            if len(out) >= 10_000:
                yield _batch(out, PART)
                out = []
        if out:
            yield _batch(out, PART)


def _of(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def judged_groups(members: DataFrame) -> DataFrame:
    """(h, d, bits): the strings of ``members`` that also start earlier in their group (a segment has several rows, or none).

    Members of a group are different. One of more than ``HOT`` is split by ranges,
    equal parts are one from then on, and the groups of parts are judged likewise;
    a range of one place has equal parts alone.
    """
    found, members = [], members.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(PARTS - 1).cast("long")})
    while True:
        crowded = common.written(members.groupBy("g1", "g2").agg(F.count("*").alias("_m")).filter(F.col("_m") > HOT), "crowded-groups")
        members = common.attach(members, crowded, ["g1", "g2"], ["h", "d"])
        few = members.filter("_m IS NULL").select(*_of(MEMBER)).repartition("g1", "g2").sortWithinPartitions("g1", "g2", "h", "d")
        found.append(few.mapInArrow(_sorted_groups, BITS).filter("bits <> 0"))
        if crowded.isEmpty():
            return common.union_all(found)
        parts = common.written(members.filter("_m IS NOT NULL").select(*_of(MEMBER), "lo", "hi").mapInArrow(_parts, PART), "parts")
        # By place first; of equal parts the first stands for all.
        rest = [c for c in _of(PART) if c not in ("g1", "g2", "c1", "c2", "known", "doc_id", "row", "start")]
        first = F.min(F.struct("known", "doc_id", "row", "start", *rest)).alias("f")
        members = common.written(parts.groupBy("g1", "g2", "c1", "c2").agg(first, F.count("*").alias("_n")), "first-parts")
        again = members.filter("_n > 1").select("g1", "g2", "c1", "c2", F.col("f.row").alias("_row"), F.col("f.start").alias("_start"))
        again = common.attach(parts.drop("seg"), common.written(again, "equal-parts"), ["g1", "g2", "c1", "c2"], ["h", "d"], "inner")
        every = F.expr("shiftleft(shiftleft(1L, cast(n AS int)) - 1, cast(shift AS int))")
        found.append(again.filter("row <> _row OR start <> _start").select("h", "d", every.alias("bits")))
        members = members.select("g1", "g2", *[F.col(f"f.{c}").alias(c) for c in [*_of(MEMBER)[2:], "lo", "hi"]])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, start, stop): what the strings of rows (row, start, bits) cover, which come row by row from left to right."""
    now: list[int] | None = None
    for batch in batches:
        out = []
        for row, start, bits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            while bits:
                skip = (bits & -bits).bit_length() - 1
                bits >>= skip
                start += skip
                ones = (~bits & (bits + 1)).bit_length() - 1
                stop = start + ones - 1 + LENGTH
                if now and now[0] == row and start <= now[2]:
                    now[2] = max(now[2], stop)
                else:
                    if now:
                        out.append(now)
                    now = [row, start, stop]
                bits >>= ones
                start += ones
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["row", "start", "stop"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in now], names=["row", "start", "stop"])


def repeated_spans(docs: DataFrame) -> str:
    """The folder of the stretches that each row of ``docs`` (row, doc_id, text) loses, by ``common.mark_rows``; start and stop are 8 bytes each, the high one first."""
    with common.scope():
        seen = common.written(suspects(docs), "suspects")
        place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "start", "n")
        first = common.written(seen.groupBy("h", "d").agg(F.min(place).alias("f"), F.count("*").alias("_copies")).select("h", "d", "f.row", "f.start", "f.n", "_copies"), "segments")
        counts = common.written(first.groupBy("h").agg(F.count("*").alias("_c")).filter("_c > 1"), "shared-hashes")
        shared = texts_of(docs, first.join(counts.select("h"), "h"))
        members = shared.select(F.col("h").alias("g1"), F.lit(0).cast("long").alias("g2"), "h", "d", F.lit(0).cast("long").alias("shift"), *_of(SEGMENT)[2:])
        bits = judged_groups(common.written(members, "shared-segments")).groupBy("h", "d").agg(F.bit_or("bits").alias("bits"))
        bits = common.written(bits, "later-strings")
        judged = first.select("h", "d", F.col("row").alias("_row1"), F.col("start").alias("_start1"), "_copies").join(bits, ["h", "d"], "left")
        judged = common.written(judged, "judged")
        # A segment of very many copies is broadcast, so that its rows stay where they are.
        often = F.broadcast(judged.filter(F.col("_copies") > COPIES))
        rows = seen.select("row", "start", "n", "h", "d")
        rows = rows.join(often, ["h", "d"]).unionByName(rows.join(often.select("h", "d"), ["h", "d"], "left_anti").join(judged.filter(F.col("_copies") <= COPIES), ["h", "d"]))
        own = (F.col("row") == F.col("_row1")) & (F.col("start") == F.col("_start1"))
        rows = rows.select("row", "start", F.when(own, F.coalesce("bits", F.lit(0))).otherwise(F.expr("shiftleft(1L, cast(n AS int)) - 1")).alias("bits")).filter("bits <> 0")
        spans = rows.repartition("row").sortWithinPartitions("row", "start").mapInArrow(_spans, "row long, start long, stop long")
        key = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("start", "stop")])
        return common.mark_rows(spans.select("row", key.alias("key")), "row", payload="key", keep=True)


def _kept(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    lost = common.Marked(folder, 16)
    for batch in batches:
        spans, kept = [], []
        for row, text in zip(batch.column(0).to_pylist(), _texts(batch.column(2)), strict=True):
            own = sorted((int.from_bytes(p[:8], "big"), int.from_bytes(p[8:], "big")) for p in lost.payloads(row))
            edges = [0, *(x for s in own for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"start": a, "length": b - a} for a, b in own])
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])


def drop_repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, kept): every row of ``docs``, read from files, with the stretches of bytes it loses and those it keeps.

    Of equal strings the one of the smallest doc_id stays, a null id before all
    others; rows that share an id go by their place in the files. A null or empty
    text loses nothing and keeps no bytes; a text of any length is read whole; an
    empty table gives an empty result; other columns are not read. What is kept
    need not be whole characters.
    """
    docs = common.numbered(docs, {"doc_id": "doc_id", "text": "text"}, "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = repeated_spans(docs)
    return docs.mapInArrow(lambda b: _kept(b, folder), "doc_id long, spans array<struct<start: long, length: long>>, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, by ``drop_repeated``: null and empty texts have no bytes, repeated rows stay rows of their own."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    rows = drop_repeated(common.documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
