"""Benchmark decontamination: test items in a BM25 index, every training passage a query, block-max WAND retrieval, overlap check.

Items are split into question and answer. A passage contaminates if it holds at
least ``OVERLAP`` of the question's and of the answer's word 5-grams (a part of
fewer words counts as one gram). An item's retrieval threshold follows from
that: a passage that passes lacks at most the words that so many missing grams
could cost, so it scores at least the item's own score less its heaviest words.
No passage that would pass the check is missed.

A document is cut into halves of ``HALF_WORDS`` words, or as many as the longest
item of the whole benchmark has if that is more, so that what is found does not
depend on how items are dealt to indexes; two neighbouring halves are a passage, so each place where an item could
stand lies within one.

Items are kept in blocks of near equal length; each term has its largest impact
in the index and in each block it stands in. First the block maxima of each
passage's terms are summed by block; a passage for which no block could reach the
threshold is done with. For all others a cursor moves through the postings of
each term: the pivot is the first item up to which the terms' largest impacts
could reach the threshold; if those of its block could not, all cursors skip the
block, else they meet at the pivot, which is scored.

Tasks build the indexes, each of a bounded number of words, as files in the
shared folder; one pass over the texts searches all of them.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import common, files

GRAM, OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
#: Items in a block, and words of all items in one index (a longer item has one for itself). A larger benchmark makes more indexes; a worker holds ``HELD_INDEXES`` of them.
BLOCK_ITEMS, INDEX_WORDS, HELD_INDEXES = 8, 100_000, 4
#: Words of half a passage, at least.
HALF_WORDS = 64
#: Words of documents searched at a time.
SEARCH_WORDS = 300_000
#: Pairs of a passage's term and a block that are summed at a time.
PAIRS = 2_000_000
WORD = re.compile(r"\w+")
ENDS = re.compile(r"[.!?](?=\s)")
NEAR_ONE = 1 - 1e-5


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """The text up to its last question mark and what follows, else all sentences but the last and the last; one sentence is all question."""
    cuts = [m.end() for m in ENDS.finditer(text) if words_of(text[: m.end()]) and words_of(text[m.end() :])]
    asked = [c for c in cuts if text[c - 1] == "?"]
    cut = (asked or cuts or [len(text)])[-1]
    return text[:cut], text[cut:]


def grams_of(words: list[str], n: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(n)), strict=False))


@dataclass
class Part:
    """A question or an answer: its grams and their length."""

    words: list[str]
    n: int = field(init=False)
    grams: set[tuple[str, ...]] = field(init=False)

    def __post_init__(self) -> None:
        self.n = min(GRAM, len(self.words))
        self.grams = grams_of(self.words, self.n) if self.words else set()

    @property
    def may_lack(self) -> int:
        """Most words of the part that a passage may lack."""
        return len(self.grams) - math.ceil(OVERLAP * len(self.grams) - 1e-9)

    def overlap(self, held: dict[int, set[tuple[str, ...]]], passage: list[str]) -> float:
        if not self.grams:
            return 1.0
        if self.n not in held:
            held[self.n] = grams_of(passage, self.n)
        return len(self.grams & held[self.n]) / len(self.grams)


class Index:
    """An inverted index of items with block maxima; impacts are in units of the item's threshold."""

    def __init__(self, items: list[tuple[int, str | None]], half: int, block_items: int):
        read = []
        for item_id, text in items:
            question, answer = question_and_answer(text or "")
            if words := words_of(text):
                read.append((len(words), item_id, Counter(words), Part(words_of(question)), Part(words_of(answer))))
        read.sort(key=lambda x: x[:2])
        self.ids = [x[1] for x in read]
        self.parts = [x[3:] for x in read]
        self.half, self.block_items = half, block_items
        self.vocabulary: dict[str, int] = {}
        df = Counter(w for _, _, tf, _, _ in read for w in tf)
        mean = sum(x[0] for x in read) / max(len(read), 1)
        postings: list[tuple[int, int, float]] = []
        for i, (n, _, tf, *parts) in enumerate(read):
            impact = {w: math.log(1 + (len(read) - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for w, f in tf.items()}
            lack = sum(p.may_lack for p in parts)
            least = sum(sorted(impact.values())[: max(1, len(impact) - lack)])
            postings += [(self.vocabulary.setdefault(w, len(self.vocabulary)), i, v / least) for w, v in impact.items()]
        postings.sort()
        self.term_at = np.searchsorted([p[0] for p in postings], np.arange(len(self.vocabulary) + 1))
        self.items = np.array([p[1] for p in postings], np.int32)
        self.impacts = np.array([p[2] for p in postings], np.float64)
        # The blocks each term stands in, one after the other, with its largest impact there.
        terms = np.repeat(np.arange(len(self.vocabulary)), np.diff(self.term_at))
        self.n_blocks = -(-len(read) // block_items)
        pairs, at = np.unique(terms * max(self.n_blocks, 1) + self.items // block_items, return_inverse=True)
        self.block_at = np.searchsorted(pairs // max(self.n_blocks, 1), np.arange(len(self.vocabulary) + 1))
        self.blocks, self.block_max = pairs % max(self.n_blocks, 1), np.zeros(len(pairs))
        np.maximum.at(self.block_max, at, self.impacts)
        self.lists: dict[int, tuple[list[int], list[float], float, dict[int, float]]] = {}

    def postings(self, term: int) -> tuple[list[int], list[float], float, dict[int, float]]:
        """A term's items, its impact on each, the largest, and the largest in each block that has any."""
        if (got := self.lists.get(term)) is None:
            own = slice(self.term_at[term], self.term_at[term + 1])
            items, impacts, blocks = self.items[own].tolist(), self.impacts[own].tolist(), {}
            for i, v in zip(items, impacts, strict=True):
                blocks[i // self.block_items] = max(blocks.get(i // self.block_items, 0.0), v)
            got = self.lists[term] = items, impacts, max(impacts), blocks
        return got

    def retrieve(self, terms: list[int]) -> Iterator[tuple[int, float]]:
        """Items whose score for the terms reaches their threshold, with the score in units of it, by pivots and block maxima."""
        lists = [self.postings(t) for t in terms]
        at, doc = [0] * len(lists), [x[0][0] for x in lists]
        order = sorted(range(len(lists)), key=doc.__getitem__)
        while order:
            total, pivot = 0.0, -1
            for j, i in enumerate(order):
                total += lists[i][2]
                if total >= NEAR_ONE:
                    pivot = j
                    break
            if pivot < 0:
                return
            target = doc[order[pivot]]
            while pivot + 1 < len(order) and doc[order[pivot + 1]] == target:
                pivot += 1
            ahead, block = order[: pivot + 1], target // self.block_items
            if sum(lists[i][3].get(block, 0.0) for i in ahead) < NEAR_ONE:
                target = (block + 1) * self.block_items
                if pivot + 1 < len(order):
                    target = min(target, doc[order[pivot + 1]])
            elif doc[order[0]] == target:
                score = sum(lists[i][1][at[i]] for i in ahead)
                if score >= NEAR_ONE:
                    yield target, score
                target += 1
            for i in ahead:
                if doc[i] < target:
                    items = lists[i][0]
                    at[i] = bisect_left(items, target, at[i])
                    doc[i] = items[at[i]] if at[i] < len(items) else -1
            order = sorted((i for i in order if doc[i] >= 0), key=doc.__getitem__)

    def _pieces(self, at: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of whole passages whose terms stand in about ``PAIRS`` blocks together."""
        upto = np.cumsum(self.block_at[terms + 1] - self.block_at[terms])
        a = 0
        while a < len(at):
            b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right"))
            b = int(np.searchsorted(at, at[min(max(b, a + 1), len(at)) - 1], side="right"))
            yield a, b
            a = b

    def search(self, docs: list[list[str]]) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) of every pair that passes, the best passage of each; documents are lists of words."""
        if not self.ids:
            return
        lengths = np.array([len(d) for d in docs])
        ids = np.fromiter((i for d in docs for i in map(self.vocabulary.get, d, repeat(-1))), np.int64, int(lengths.sum()))
        doc = np.repeat(np.arange(len(docs)), lengths)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        known = np.flatnonzero(ids >= 0)
        ids, doc, place = ids[known], doc[known], place[known]
        halves = lengths // self.half + 1
        half_at = np.cumsum(halves) - halves
        half = place // self.half
        passage = half_at[doc] + half
        # A passage is its own half and the next of the same document; a term counts once in it.
        size = max(len(self.vocabulary), 1)
        own = np.unique(np.concatenate([passage * size + ids, (passage * size + ids - size)[half > 0]]))
        at, terms = own // size, own % size
        found = []
        for a, b in self._pieces(at, terms):
            counts = self.block_at[terms[a:b] + 1] - self.block_at[terms[a:b]]
            starts = np.repeat(self.block_at[terms[a:b]] - (np.cumsum(counts) - counts), counts)
            place = starts + np.arange(len(starts))
            bound = np.bincount((np.repeat(at[a:b], counts) - at[a]) * self.n_blocks + self.blocks[place], self.block_max[place])
            found.append(np.unique(np.flatnonzero(bound >= NEAR_ONE) // self.n_blocks) + at[a])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p in np.concatenate(found).tolist() if found else ():
            d = int(np.searchsorted(half_at, p, side="right")) - 1
            a, b = np.searchsorted(at, [p, p + 1])
            held, text = {}, None
            for i, score in self.retrieve(terms[a:b].tolist()):
                if text is None:
                    start = (p - int(half_at[d])) * self.half
                    text = docs[d][start : start + 2 * self.half]
                question, answer = self.parts[i]
                q = question.overlap(held, text)
                r = answer.overlap(held, text) if q >= OVERLAP else 0.0
                if q >= OVERLAP and r >= OVERLAP:
                    best[d, self.ids[i]] = max(best.get((d, self.ids[i]), (0.0, 0.0, 0.0)), (score, q, r))
        for (d, item), found in best.items():
            yield (d, item, *found)


def longest(benchmark: DataFrame) -> int:
    """Words of the longest item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words_of(x.as_py())) for x in batch.column(0)], pa.int64())], names=["n"])

    return benchmark.select("text").mapInArrow(read, "n bigint").agg(F.max("n")).first()[0] or 0


def write_indexes(benchmark: DataFrame) -> list[str]:
    """The benchmark in indexes of about ``INDEX_WORDS`` at most, items of like length together, as files; their paths.

    Lengths in rising order share an index while it has room; a length that needs
    more than one is sliced by hash. Only counts by length reach the driver.
    """
    half, block_items = max(HALF_WORDS, longest(benchmark)), BLOCK_ITEMS
    sized = benchmark.select("item_id", "text").withColumn("_n", F.floor(F.coalesce(F.length("text"), F.lit(0)) / 2) + 1)
    dealt, share, used = [], 0, 0
    for n, items in sorted(sized.groupBy("_n").agg(F.count("*")).collect()):
        if used and used + n * items > INDEX_WORDS:
            share, used = share + 1, 0
        slices = max(1, min(items, -(-n * items // INDEX_WORDS)))
        dealt.append((n, share, slices))
        share, used = share + slices - 1, used + n * items // slices
    if not dealt:
        return []
    folder = common.new_path(benchmark.sparkSession, "benchmark-indexes")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, str | None]]] = {}

        def put(share: int) -> str:
            files.replace(path := f"{folder}/{share}", pickle.dumps(Index(held.pop(share), half, block_items)))
            return path

        for batch in batches:
            for share, item_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if share not in held and held:
                    yield pa.RecordBatch.from_arrays([pa.array([put(next(iter(held)))])], names=["path"])
                held.setdefault(share, []).append((item_id, text))
        for share in list(held):
            yield pa.RecordBatch.from_arrays([pa.array([put(share)])], names=["path"])

    shares = benchmark.sparkSession.createDataFrame(dealt, "_n bigint, _first bigint, _slices bigint")
    own = F.col("_first") + common.sliced(F.col("_slices"), F.col("item_id"), F.col("text"))
    rows = sized.join(F.broadcast(shares), "_n").select(own.alias("_share"), F.col("item_id").cast("long").alias("item_id"), "text")  # a row a length
    paths = rows.repartition("_share").sortWithinPartitions("_share").mapInArrow(build, "path string").distinct()
    return sorted(r.path for r in paths.collect())


class Searcher:
    """All indexes as a task reads them."""

    def __init__(self, paths: list[str]):
        self.paths, self.held = paths, {}

    def _at(self, path: str) -> Index:
        if path not in self.held:
            if len(self.held) >= HELD_INDEXES:
                self.held.pop(next(iter(self.held)))
            with files.opened(path) as f:
                self.held[path] = pickle.loads(f.read())
        return self.held[path]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of every pair that passes; texts are cut into words once."""
        words, size, first = [], 0, 0
        for k, text in enumerate(texts):
            words.append(words_of(text))
            size += len(words[-1])
            if size > SEARCH_WORDS or k + 1 == len(texts):
                for path in self.paths:
                    for i, *rest in self._at(path).search(words):
                        yield (first + i, *rest)
                words, size, first = [], 0, k + 1


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), a row for each contaminated document and item."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    paths = write_indexes(benchmark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(paths)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *rest) for i, *rest in searcher.search(batch.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)
    best = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    return found.groupBy("doc_id", "item_id").agg(*best)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a contaminating passage, all columns unchanged; nothing is shuffled."""
    at, paths = docs.columns.index("text"), write_indexes(benchmark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(paths)
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            kept[[i for i, *_ in searcher.search(batch.column(at).to_pylist())]] = False
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(search, docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with their items.

    Null and empty texts and items match nothing; texts of any length are
    searched whole; rows that share a doc_id count as one; an empty table of
    documents or of items gives an empty result; other columns are not read.
    """
    return matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@common.staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go, all others stay with all their columns.

    Null and empty texts stay; repeated rows stay or go together; an empty table,
    or no benchmark items, changes nothing; no column name is reserved.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
