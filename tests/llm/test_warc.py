from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import re

import duckdb

from stratakit.llm import warc as W


def slow(rows):
    """The contract by hand: of equal payloads the largest page_id answers."""
    groups: dict[bytes, list] = {}
    for i, (page_id, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page_id is not None, page_id or 0, -i))
    out = []
    for i, (page_id, html) in enumerate(rows):
        payload = (html or "").encode()
        last = max(groups[payload])
        revisit = last[2] != -i
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", last[1] if revisit and last[0] else None))
    return sorted(out, key=str)


def test_query_equals_brute_force_and_sql(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = sorted(map(tuple, W.op7_warc(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == slow(rows)
    duckdb.sql("CREATE OR REPLACE TEMP VIEW pages AS FROM '/root/testdata/sf0.001/pages.parquet'")
    assert sorted(duckdb.sql(W.OP7_SQL).fetchall(), key=str) == got


def test_odd_rows(spark, as_tables):
    rows = [(1, "u", "a"), (2, None, "a"), (3, "u\r\nv", "a"), (3, "u", "a"), (4, "u", ""), (None, None, None), (5, "u", "WARC/1.1\r\nx\r\n\r\n"), (-6, "u", "é" * 300_000), (None, "u", "é" * 300_000), (7, "u", "\x1f\x8b\x08 in a page")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS row", "2 AS sha", "3 AS revisit")
    got = sorted(map(tuple, W.op7_warc(spark, as_tables(pages=frame)).collect()), key=str)
    want = slow([(a, c) for a, _, c in rows])
    # Which of two rows with equal id and payload is the response is open; how many are is not.
    assert sorted(g[:4] for g in got if g[0] is not None) == sorted(s[:4] for s in want if s[0] is not None)
    assert sorted((g[1:4] for g in got if g[0] is None)) == sorted((s[1:4] for s in want if s[0] is None))


def test_long_urls_and_control_characters(spark, as_tables):
    rows = [(1, "http://x/" + "u" * 1_000_000, "a"), (2, "http://x/\x00\x07 y\r\n\r\nz", "b"), (3, "", "c" * 3_000_000)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted(r.page_id for r in W.op7_warc(spark, as_tables(pages=frame)).collect()) == [1, 2, 3]


def test_lengths_that_are_none():
    """A damaged length ends neither the job nor the reading of what follows."""
    parts = members(3)
    for n in ("²", "9" * 5000, "9" * 18, "-1", "", "1_0"):
        bad = W.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:9>")], b"this").replace(b"Content-Length: 4", f"Content-Length: {n}".encode())
        for data in (W.gzip_member(bad), bad):
            whole = parts[0] + data + parts[1]
            assert read(whole)[0] == [0, 1]
            got = list(W.salvage(io.BytesIO(whole), len(whole)))
            assert [g[0] for g in got] == ["record", "gap", "record"]
    full = W.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:9>"), ("WARC-Payload-Length", "²")], b"this")
    assert read(full)[0] == [9]


def test_empty_table(spark, as_tables):
    assert W.op7_warc(spark, as_tables(pages=spark.createDataFrame([], "page_id bigint, url string, html string"))).count() == 0


def members(n=40, zipped=True):
    draw = random.Random(5)
    records = [W.page_record(i, f"http://x/{i}", bytes(draw.randrange(32, 127) for _ in range(draw.randrange(0, 3000))), False, None) for i in range(n)]
    return [W.gzip_member(r) if zipped else r for r in records]


def read(data: bytes):
    got = list(W.salvage(io.BytesIO(data)))
    ids = [int(m[1]) if (m := re.fullmatch(r"<urn:page:(\d+)>", h["warc-record-id"])) else -1 for kind, _, _, h, _ in got if kind == "record"]
    return ids, [(at, n) for kind, at, n, _, _ in got if kind == "gap"], got


def test_sound_archives_have_no_gaps(monkeypatch):
    for zipped in (True, False):
        for chunk in (7, 1 << 20):
            monkeypatch.setattr(W, "CHUNK", chunk)
            ids, gaps, got = read(b"".join(members(zipped=zipped)))
            assert ids == list(range(40)) and not gaps
    assert read(b"") == ([], [], [])
    assert read(gzip.compress(b"".join(members(3, False))))[0] == [0, 1, 2]


def test_damage_costs_only_the_damaged_members():
    draw = random.Random(9)
    for zipped in (True, False):
        parts = members(zipped=zipped)
        starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        for _ in range(40):
            hurt = sorted(draw.sample(range(40), 3))
            broken = [bytearray(p) for p in parts]
            for i in hurt:
                at = draw.randrange(len(broken[i]))
                broken[i][at] ^= 1 << draw.randrange(8)
            ids, gaps, got = read(b"".join(map(bytes, broken)))
            assert set(range(40)) - set(hurt) <= set(ids)
            for i in set(hurt) - set(ids) if zipped else ():  # what is lost is logged; no checksum guards a plain record's id
                assert any(at <= starts[i] < at + n for at, n in gaps)
            covered = {(at, n) for kind, at, n, _, _ in got}
            assert sum(n for _, n in covered) == starts[-1]


def test_truncation_garbage_and_bad_digest():
    parts = members(5)
    ids, gaps, _ = read(b"garbage" + parts[0] + b"\x1f\x8b\x08junk" + parts[1] + parts[2][:-9])
    assert ids == [0, 1] and gaps[0] == (0, 7) and len(gaps) == 3
    bad = W.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:9>"), ("WARC-Payload-Digest", "sha1:" + W.digest(b"other"))], b"this")
    assert read(W.gzip_member(bad) + parts[3])[0] == [3]


def test_reader_over_many_archives(spark, tmp_path):
    parts = members(30)
    for k in range(3):
        data = b"".join(parts[10 * k : 10 * k + 10])
        (tmp_path / f"{k}.warc.gz").write_bytes(data[: len(data) // 2] + b"\0" * 5 + data[len(data) // 2 :] if k == 1 else data)
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    records = W.read_archives(paths)
    assert records.filter("kind = 'record'").count() >= 29
    assert W.gaps(records).count() == 1
