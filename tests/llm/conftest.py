from __future__ import annotations

import pytest

WORDS = "river stone lamp green quiet maple bread cloud seven under paper grain vivid north ember".split()

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(n: int, seed: int = 0) -> str:
    """n words, the same for the same seed, hardly any three in a row again."""
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[(state >> 8) % len(WORDS)] + WORDS[(state >> 16) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and a clashing extra column."""
    long = prose(30_000, 3)
    rows = [
        (1, prose(80, 1), "en", "s1"), (2, prose(80, 1), "en", "s1"), (2, prose(80, 1), "en", "s1"), (3, "", "en", "s2"), (4, None, None, None),
        (None, prose(60, 2), "en", "s1"), (None, None, None, None), (5, long, "de", "s2"), (6, " \t\n", "de", None), (7, "One", "de", "s2"),
        (8, "Ünï çödé 😀 words\nand lines\n\nand lines", "fr", "s3"), (9, prose(70, 4), None, "s3"), (10, prose(70, 4), "fr", "s1"), (-3, "neg", "fr", "s1"),
    ]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC_SCHEMA)
    return frame.selectExpr("*", "doc_id AS fp", "'x' AS cell", "1 AS size", "2 AS _salt", "3 AS n_words", "4 AS _row", "5 AS root")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture
def as_tables(spark, tmp_path):
    """Write frames as the tables of a folder, as the queries read them."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
