"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged ones.

The reader takes gzip members one by one (or plain records, by their version
line). A member or record that fails its checks (gzip checksum, header form,
length, digest) does not end the file: the reader searches for the next gzip
member or version line that reads well, recovers what follows and reports the
bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import common, files

VERSION = b"WARC/1.1"
#: Compressed bytes after which a task begins another archive, and bytes read at a time.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
GZIP_HEAD = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/[0-9]\.[0-9]")
#: A length as headers state it, and bytes that no header line holds.
NUMBER, CONTROL = re.compile(r"[0-9]{1,19}"), re.compile(rb"[\x00-\x08\x0b-\x1f\x7f]")
DATE = "2024-01-01T00:00:00Z"
#: Smallest payload that a revisit record stands for.
MIN_REVISIT = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *[f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that names the page whose response holds the same payload."""
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record_bytes(head, b"" if revisit else payload)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def field_of(line: bytes) -> tuple[str, str] | None:
    """Name, in lower case, and value of a header line; None if it has another form."""
    name, colon, value = line.partition(b":")
    if not colon or not name or name != name.strip() or CONTROL.search(line):
        return None
    return name.decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")


class Source:
    """A file's bytes from a moving place, read in chunks; only what is still needed is held."""

    def __init__(self, file: IO[bytes], size: int | None = None):
        self.file, self.size, self.held, self.at, self.ended = file, size, bytearray(), 0, False

    def fill(self, n: int) -> bool:
        """Hold at least n bytes from the place on, if the file has them; where its size is known, one that has not is not read."""
        if self.size is not None and self.at + n > self.size and n > len(self.held) + CHUNK:
            return False
        while len(self.held) < n and not self.ended:
            chunk = self.file.read(max(CHUNK, n - len(self.held)))
            self.ended = not chunk
            self.held += chunk
        return len(self.held) >= n

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def read_headers(data: Source) -> tuple[dict[str, str], int] | None:
    """The fields of the header block at the place and its length; None at the first line of another form, so little is held of what is none."""
    out: dict[str, str] = {}
    line_at = seen = 0
    while True:
        while (end := data.held.find(b"\n", seen)) < 0:
            if CONTROL.search(data.held[seen:].removesuffix(b"\r")):
                return None
            seen = len(data.held)
            if not data.fill(seen + 1):
                return None
        line = bytes(data.held[line_at:end]).removesuffix(b"\r")
        if line_at == 0:
            if not START.fullmatch(line):
                return None
        elif not line:
            break
        elif (found := field_of(line)) is None:
            return None
        else:
            out[found[0]] = found[1]
        line_at = seen = end + 1
    stated = NUMBER.fullmatch(out.get("content-length", "")) and out.get("warc-type") and out.get("warc-record-id")
    return (out, end + 1) if stated else None


def read_plain(data: Source) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and length of the plain record at the place; None if there is none that passes."""
    found = read_headers(data)
    if found is None:
        return None
    headers, start = found
    n = int(headers["content-length"])
    # The record's closing line ends also tell a wrong length.
    if not data.fill(start + n + 2):
        return None
    tail = bytes(data.held[start + n : start + n + 4]) if data.fill(start + n + 4) else bytes(data.held[start + n :])
    close = 4 if tail[:4] == b"\r\n\r\n" else 2 if tail[:2] == b"\n\n" else 0
    return (headers, bytes(data.held[start : start + n]), start + n + close) if close else None


def sound(headers: dict[str, str], block: bytes) -> bool:
    """Does a response's block have the digest that its header states?"""
    stated = headers.get("warc-payload-digest", "")
    return headers.get("warc-type") != "response" or not stated.startswith("sha1:") or stated[5:] == digest(block)


class _Whole:
    """A file of bytes that are in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def read(self, n: int) -> bytes:
        out, self.data = self.data, b""
        return out


def read_member(data: Source) -> tuple[list[tuple[dict[str, str], bytes]], int] | None:
    """The records of the gzip member at the place and its length; None if it fails any check."""
    z, out, used = zlib.decompressobj(31), bytearray(), 0
    try:
        while not z.eof:
            if not data.fill(used + 1):
                return None
            piece = bytes(data.held[used : used + CHUNK])
            out += z.decompress(piece)
            used += len(piece) - len(z.unused_data)
    except zlib.error:
        return None
    inner, records = Source(_Whole(bytes(out)), len(out)), []
    while inner.fill(1):
        found = read_plain(inner)
        if found is None or not sound(found[0], found[1]):
            return None
        records.append(found[:2])
        inner.skip(found[2])
    return records, used


def salvage(file: IO[bytes], size: int | None = None) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record", place, length, headers, block) of every sound record and ("gap", place, length, {}, b"") of every run of bytes that is none.

    Records of a member share its place and length. Bytes after a place that
    fails are searched for the next member head or version line; one that fails
    its own checks stays in the gap. ``size`` is the file's, if it is known: a
    record that states more than is left fails at once.
    """
    data, gap_at = Source(file, size), None
    while data.fill(1):
        data.fill(16)
        got = None
        if data.held.startswith(GZIP_HEAD):
            got = read_member(data)
        elif data.held.startswith(b"WARC/"):
            found = read_plain(data)
            got = ([found[:2]], found[2]) if found and sound(found[0], found[1]) else None
        if got is not None:
            if gap_at is not None:
                yield "gap", gap_at, data.at - gap_at, {}, b""
                gap_at = None
            for headers, block in got[0]:
                yield "record", data.at, got[1], headers, block
            data.skip(got[1])
            continue
        gap_at = data.at if gap_at is None else gap_at
        data.skip(1)
        while True:  # to the next place that could begin a member or record
            places = [i for head in (GZIP_HEAD, b"WARC/") if (i := data.held.find(head)) >= 0]
            if places:
                data.skip(min(places))
                break
            data.skip(max(0, len(data.held) - 4))
            if not data.fill(len(data.held) + 1):
                data.skip(len(data.held))
                break
    if gap_at is not None:
        yield "gap", gap_at, data.at - gap_at, {}, b""


def plan_revisits(pages: DataFrame) -> DataFrame:
    """(row, refers_to) for each row of ``pages`` (row, page_id, html) that is a revisit.

    Of rows with equal payloads the one with the largest page_id (of several,
    the first row) is the response. Only ids and digests are shuffled.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = pages.select("row", "page_id", F.sha1(payload).alias("sha"), F.length(payload).alias("n")).filter(F.col("n") >= MIN_REVISIT)
    keys = common.written(keys, "payload-keys")
    best = F.max_by("row", F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), -F.col("row")))
    groups = keys.groupBy("sha", "n").agg(F.count("*").alias("_n"), best.alias("_row"), F.max("page_id").alias("refers_to")).filter("_n > 1")
    groups = common.written(groups.drop("_n"), "payload-groups")
    return common.attach(keys, groups, ["sha", "n"], salt_by=["row"], how="inner").filter("row <> _row").select("row", F.lit(True).alias("revisit"), "refers_to")


def write_pages(pages: DataFrame) -> DataFrame:
    """Write a WARC record for every row of ``pages`` (page_id, url, html; null html: empty); the manifest of the archives (path, records, bytes)."""
    folder = common.new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("row", F.monotonically_increasing_id())
    rows = common.written(rows, "warc-pages")
    planned = rows.join(plan_revisits(rows), "row", "left").select("page_id", "url", "html", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, n, seq = None, "", 0, 0, 0
        for batch in batches:
            html = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{folder}/{files.attempt_name('pages', seq)}.warc.gz"
                    out = files.create(name)
                page_id, url, _, revisit, refers_to = (None if k == 2 else batch.column(k)[i].as_py() for k in range(5))
                member = gzip_member(page_record(page_id, url, html[i].as_py() or b"", revisit, refers_to))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"path": name, "records": n, "bytes": size}])
                    out, size, n, seq = None, 0, 0, seq + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "records": n, "bytes": size}])

    return common.written(planned.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


RECORDS = "path string, kind string, place long, length long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record and every gap of the archives in ``paths`` (path).

    A row a record (kind "record": types, ids, digest, length of the full
    payload, the payload itself if asked for) or gap (kind "gap": place and
    length of the quarantined bytes). Archives are read in chunks.
    """
    names = [field.split()[0] for field in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.opened(path) as f:
                    for kind, place, length, head, block in salvage(f, files.size(path)):
                        stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or (digest(block) if kind == "record" else None)
                        full = head.get("warc-payload-length", "")
                        n = int(full) if NUMBER.fullmatch(full) and int(full) < 1 << 63 else len(block) if kind == "record" else None
                        rows.append((path, kind, place, length, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), stated, n, block if payloads else None))
                        held += len(block)
                        if held > CHUNK or len(rows) >= 2000:
                            yield _records(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _records(rows, names)

    n = paths.count()
    return paths.select("path").repartition(max(1, min(n, 10_000)), "path").mapInArrow(read, RECORDS)


def _records(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"place": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(k, pa.string())) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return records.filter("kind = 'gap'").select("path", "place", "length")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``pages``, from the archives; the log of gaps is written beside them.

    Null ids stay null; a null html is an empty payload; urls and texts may have
    any length; of repeated rows one is the response; an empty table gives an
    empty result; other columns are not read.
    """
    records = common.written(read_archives(write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False).drop("payload"), "warc-records")
    common.written(gaps(records), "warc-gaps")
    records = records.filter("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER w AS last
  FROM p WINDOW w AS (PARTITION BY html)),
b AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(hex || '0', 1 + (i * 5) // 4, 2))::INTEGER >> (3 - (i * 5) % 4)) & 31), 1)) AS digits FROM g)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(digits, '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN last END AS refers_to
FROM b
"""
