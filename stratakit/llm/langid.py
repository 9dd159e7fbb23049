"""Language ID, words first: known words by their log frequency in each language, unseen ones by character n-grams.

Counts cover all words of all training documents and all n-grams of these words;
both are tables. Every worker holds the ``HEAD`` most frequent words; a text's
other words are joined with the word table, and those that it lacks, each once,
with the n-gram table: an unseen word has the mean of its longest n-grams
(``LONGEST`` down to 1 characters) that are known. ``HEAD`` decides what is
joined, not what is known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import common

HEAD, LONGEST = 400_000, 5
SMOOTH = 0.5
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Words or n-grams counted by a task before it sends them on, and rows of words in a batch.
HELD, SENT = 200_000, 50_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(rows: Iterator[tuple[str, list[str]]], name: str) -> Iterator[pa.RecordBatch]:
    """(lang, ``name``, n): a task's own counts of (lang, items)."""
    held: dict[str, Counter[str]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, items in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(items)), pa.array(items.keys(), pa.string()), pa.array(items.values(), pa.int64())], names=["lang", name, "n"])

    for k, (lang, items) in enumerate(rows):
        held.setdefault(lang, Counter()).update(items)
        if k % 64 == 0 and sum(map(len, held.values())) > HELD:
            yield from sent()
            held = {}
    yield from sent()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(((lang, words_of(text.as_py())) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True)), "word")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = ((lang, word) for b in batches for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    yield from _counted(((lang, [g for n in range(1, LONGEST + 1) for g in grams_of(word, n)]) for lang, word in pairs), "gram")


@dataclass
class Model:
    """Languages with the log share of their words (``prior``), log frequencies of words (word, n, v0, v1 and so on) in each, n-grams (gram, k, c0, c1 and so on) with their counts, and by length the logs of what these are divided by."""

    langs: list[str]
    prior: np.ndarray
    words: DataFrame
    grams: DataFrame
    least: dict[int, list[float]]


def _by_item(counts: DataFrame, item: str, langs: list[str]) -> DataFrame:
    """(item, n, c0, c1 and so on): its count in all and in each language."""
    each = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, x in enumerate(langs)]
    return counts.groupBy(item).agg(F.sum("n").alias("n"), *each)


def _logs(least: list[float]) -> list[Column]:
    """log((count + SMOOTH) / total) for each language, ``least`` being the logs of the totals."""
    return [(F.log(F.col(f"c{i}") + F.lit(SMOOTH)) - F.lit(t)).alias(f"v{i}") for i, t in enumerate(least)]


def fit(docs: DataFrame) -> Model:
    """Learn from ``docs`` (text, lang); rows with a null in either teach nothing."""
    train = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    langs = sorted(r.lang for r in train.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros(0), docs.limit(0), docs.limit(0), {})
    counts = train.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = common.written(counts, "language-words")
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([sizes.get(x, 0) for x in langs], np.float64)
    prior = np.log((totals + SMOOTH) / (totals.sum() + SMOOTH * len(langs)))
    words = common.written(_by_item(counts, "word", langs), "language-word-counts")
    words = words.select("word", "n", *_logs(np.log(totals + SMOOTH * (words.count() + 1)).tolist()))
    # Each word once in a language, so that unseen words are likened to rare ones.
    found = counts.select("lang", "word").mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = common.written(_by_item(found, "gram", langs).withColumn("k", F.length("gram")).drop("n"), "language-grams")
    by_length = grams.groupBy("k").agg(F.count("*").alias("kinds"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(len(langs))]).collect()  # a row a length
    least = {r.k: [float(np.log(r[f"s{i}"] + SMOOTH * (r.kinds + 1))) for i in range(len(langs))] for r in by_length}
    return Model(langs, prior, words, grams, least)


def head_of(words: DataFrame) -> pa.Table:
    """(word, v0, v1 and so on) of at most ``HEAD`` words, the most frequent, whole steps of a sixteenth of a doubling."""
    step = F.floor(F.log2("n") * 16)
    total, least = 0, None
    for r in sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect(), reverse=True):  # under a thousand rows
        total += r.c
        if total > HEAD:
            break
        least = r.s
    return words.filter(step >= least if least is not None else F.lit(False)).drop("n").toArrow()


def _part(n: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(F.col("m"), i, F.lit(n))


def unseen(words: DataFrame, model: Model) -> DataFrame:
    """(word, v0, v1 and so on) for written distinct ``words`` (word): the mean over the longest n-grams of a word that are known; none where no n-gram is."""
    k, out = len(model.langs), words.select("word", *[F.lit(0.0).alias(f"v{i}") for i in range(len(model.langs))]).limit(0)
    left = words.select("word", F.concat(F.lit("<"), "word", F.lit(">")).alias("m"))
    for n in range(LONGEST, 0, -1):
        if n not in model.least or left.isEmpty():
            continue
        each = F.transform(F.sequence(F.lit(1), F.length("m") - n + 1), _part(n))
        pairs = left.filter(F.length("m") >= n).select("word", F.explode(each).alias("gram"))
        known = model.grams.filter(F.col("k") == n).select("gram", *_logs(model.least[n]))
        found = pairs.join(known, "gram").groupBy("word").agg(*[F.avg(f"v{i}").alias(f"v{i}") for i in range(k)])
        found = common.written(found, "unseen-scores")
        out = out.unionByName(found)
        left = common.written(left.join(found.select("word"), "word", "left_anti"), "unseen-words")
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, read from files, from its whole text alone.

    ``score`` is the language's share of the likelihood; of equal ones the first
    by code point stands. ``und`` and 0 where the text is null or has no letter,
    or nothing was learned.
    """
    spark, k = docs.sparkSession, len(model.langs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not k:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    top = head_of(model.words)
    vectors = np.column_stack([top.column(f"v{i}").to_numpy() for i in range(k)])
    held = spark.sparkContext.broadcast((top.column("word").to_pylist(), vectors, model.prior))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("letter", pa.bool_()), ("known", pa.list_(pa.float64())), ("word", pa.string()), ("tf", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, prior = held.value
        index = {w: i for i, w in enumerate(names)}
        for batch in batches:
            texts, rest = [], []

            def sent() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*texts, *rest, strict=True), schema, strict=True)], schema=schema)

            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(text := text.as_py() or "")
                at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                score = prior + vectors[at[at >= 0]].sum(axis=0)
                texts.append((row, doc_id, next(filter(str.isalpha, text), None) is not None, score.tolist(), None, None))
                rest += [(row, None, None, None, w, n) for w, n in Counter(words[i] for i in np.flatnonzero(at < 0).tolist()).items()]
                if len(rest) > SENT:
                    yield sent()
                    texts.clear()
                    rest.clear()
            if texts or rest:
                yield sent()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    both = common.written(rows.mapInArrow(read, "row long, doc_id long, letter boolean, known array<double>, word string, tf long"), "language-texts")
    texts, rest = both.filter("word IS NULL").select("row", "doc_id", "letter", "known"), both.filter("word IS NOT NULL").select("row", "word", "tf")
    table = model.words.drop("n")
    missing = common.written(rest.select("word").distinct().join(table, "word", "left_anti"), "unseen-words")
    table = table.unionByName(unseen(missing, model))
    more = rest.join(table, "word").groupBy("row").agg(*[F.sum(F.col("tf") * F.col(f"v{i}")).alias(f"_s{i}") for i in range(k)])
    sums = F.array(*[F.col("known")[i] + F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(k)]).cast("array<double>")
    out = texts.join(more, "row", "left").select("doc_id", "letter", sums.alias("_v")).withColumn("_most", F.array_max("_v"))
    share = 1 / F.aggregate("_v", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_most")))
    told = F.col("letter") & F.col("_most").isNotNull()
    named = F.element_at(F.array(*map(F.lit, model.langs)).cast("array<string>"), F.array_position("_v", F.col("_most")).cast("int"))
    return out.select("doc_id", held_out().alias("held_out"), F.when(told, named).otherwise(UNKNOWN).alias("lang_pred"), F.when(told, share).otherwise(0.0).alias("score"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, repeated ones too.

    A null id counts as empty text for the fold; null and empty texts are
    ``und``; a text of any length is read whole; a language whose training texts
    hold no letter is known by name alone; an empty table gives an empty result;
    other columns are not read.
    """
    docs = common.documents(spark, sf_dir)
    return predict(docs, fit(docs.filter(~held_out())))
