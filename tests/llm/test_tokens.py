from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratakit.llm import common, tokens

PATH = public_tokenizers.path(tokens.VOCABULARY)


def expected(rows):
    whole = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_texts(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001")
    got = sorted(map(tuple, tokens.op1_tokens(spark, "/root/testdata/sf0.001").collect()))
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_docs, no_docs, as_tables, monkeypatch):
    got = tokens.op1_tokens(spark, as_tables(documents=odd_docs)).collect()
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    strip = lambda rows: sorted(((i, n, c) for i, _, n, c in rows), key=str)
    assert strip(got) == strip(want)
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    by_start = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert by_start == sorted(by_start, key=lambda i: (i is not None, i or 0))
    assert tokens.stage(spark, no_docs, "").count() == 0


def test_small_shards_keep_the_order(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', cast(id % 17 AS int)) AS text").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(tokens, "SHARD_IDS", 40)
    assert sorted(map(tuple, tokens.stage(spark, docs, "").collect())) == expected(rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 's\n\t.É😀 \x1c1<|endoftx>"), max_size=40))
def test_parts_equal_the_whole(text):
    code = tokens.encoder(PATH)
    assert code.parted and code.encode(text) == code._ids(text).tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**45), max_size=700), st.integers(0, 40))
def test_elias_fano_round_trip(values, shift):
    values = np.sort(np.array(values, np.int64) >> shift)
    held = tokens.EliasFano.from_bytes(tokens.EliasFano.of(values).to_bytes())
    assert list(held.cursor()) == values.tolist()
    assert [held.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 50_000))
    bits = 8 * len(tokens.EliasFano.of(values).to_bytes()) / len(values)
    assert bits < 2.5 + np.log2(values[-1] / len(values))


def test_added_tokens_are_as_the_library_gives_them():
    whole = Tokenizer.from_file(PATH)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x\n <|endoftext|>\n\ny<|endoftext|>z"):
        assert np.frombuffer(tokens.encoder(PATH).encode(text), tokens.encoder(PATH).kind).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_new_words_are_encoded_once_and_together(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 12)
    code, whole, asked = tokens.Encoder(PATH), Tokenizer.from_file(PATH), []
    monkeypatch.setattr(code, "_ids", lambda text, real=code._ids: asked.append(text) or real(text))
    for text in ("one two, one\ntwo \u0120x", "one two, one\nthree", "two\u2003one", "", "\u0120x 12's\n" + " ".join(f"w{i}" for i in range(15)), "one two"):
        assert np.frombuffer(code.encode(text), code.kind).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(code.young) <= 20 and len(code.old) <= 20
    assert len(asked[0]) == len("\none two, one\ntwo \u0120x")
    assert asked[1] == "\nthree"


def test_not_a_shard():
    with pytest.raises(ValueError):
        tokens.read_shard(b"x" * 100)
