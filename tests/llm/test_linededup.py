from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

from stratakit.llm import bloom, common, linededup as L


def slow(rows):
    fold = str.maketrans(common.UPPER, common.LOWER)
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(fold)
    holders: dict[str, set] = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc_id)
    last = {k: max((d for d in ds if d is not None), default=None) for k, ds in holders.items() if len(ds) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force_and_sql(spark):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, "/root/testdata/sf0.001").collect()]
    got = sorted(map(tuple, L.op9_line_dedup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == slow(rows) and any(r[2] for r in got)
    duckdb.sql("CREATE OR REPLACE TEMP VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(duckdb.sql(L.OP9_SQL).fetchall(), key=str) == got


@pytest.mark.parametrize("full", [False, True])
def test_odd_rows_and_a_full_filter(spark, odd_docs, as_tables, monkeypatch, tmp_path, full):
    """A filter that lets everything through changes nothing in the result."""
    if full:
        for s in range(64):
            (tmp_path / str(s)).write_bytes(b"\xff" * (bloom.SLICE_BITS // 8))
        monkeypatch.setattr(L, "seen_twice", lambda docs: (str(tmp_path), 64))
    line, odd = "The same line of at least twenty", "exactly twenty cps é"
    extra = [(20 + i, f"x{i}\n{line}\n \t{line.upper()}\r\n{odd if i < 3 else odd[1:]}") for i in range(5)] + [(None, f"{line}\n"), (24, f"{odd}\n{line}")]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string")).selectExpr("*", "1 AS keys", "2 AS n_lines")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, L.op9_line_dedup(spark, as_tables(documents=docs)).collect()), key=str) == slow(rows)


def test_empty_table(spark, no_docs, as_tables):
    assert L.op9_line_dedup(spark, as_tables(documents=no_docs)).count() == 0


def test_filters_grow_with_the_lines(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, None), (3, "c")], "doc_id bigint, text string")
    assert L.slices_for(docs) == 64
    monkeypatch.setattr(bloom, "LEAST_SLICES", 1)
    monkeypatch.setattr(bloom, "HASH_BITS", bloom.SLICE_BITS)
    assert L.slices_for(docs) == 8  # five lines
