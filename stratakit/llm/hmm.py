"""Language-model scoring by a hidden Markov model over the words of a text.

Words have classes: each of the at most ``HEAD`` most frequent words of the
training text is one, all others share ``TAIL`` classes by hash. A state emits a
class, and a class a word by its smoothed count, so the parameters of the states
are bounded while word counts cover the whole corpus. Baum-Welch counts are
summed across tasks and partitions. Every round reads all training texts: those
of the start take each text to be in one state, the others are Baum-Welch. The
scaled forward recursion then gives each text's exact likelihood.

One pass over the texts writes their classes; training and scoring read those.
Rare words alone are joined with their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import common

STATES, ROUNDS, START_ROUNDS = 8, 2, 6
HEAD, TAIL = 50_000, 4096
#: Texts whose steps run side by side, cells of a batch, and steps whose forward values are held at once.
WIDE, CELLS, HELD_STEPS = 512, 400_000, 8192
#: Distinct words a task counts before it sends them on.
HELD_WORDS = 300_000
#: Classes in a block of counts.
BLOCK = 1024
#: Mass of the whole text's distribution in each state's.
PRIOR = 50.0
#: The token that ends a text; no word is empty.
END = b""


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(common.FOLD).split(), END]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): a task's own counts of tokens."""
    sent = lambda held: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
    held: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            held.update(tokens_of(text.as_py()))
            if len(held) > HELD_WORDS:
                yield sent(held)
                held = Counter()
    if held:
        yield sent(held)


@dataclass
class Vocabulary:
    """Classes of words with their counts: ``head`` words by themselves (the end first), the rest by hash."""

    head: dict[bytes, int]
    counts: np.ndarray  # tokens of each class
    kinds: np.ndarray  # distinct words of each class
    n: int
    v: int
    tail: int

    @property
    def size(self) -> int:
        return len(self.head) + self.tail

    def tail_class(self, word: bytes) -> int:
        return len(self.head) + xxhash.xxh64_intdigest(word) % self.tail

    def smoothed(self) -> np.ndarray:
        """Counts with one more for each word and, in a shared class, one for words never seen."""
        out = self.counts + self.kinds + 0.0
        out[len(self.head) :] += 1
        return out


def vocabulary(words: DataFrame) -> Vocabulary:
    """From written ``words`` (word, n); only the head and sums by class reach the driver."""
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * 16)  # counts by sixteenths of a doubling: under a thousand rows, however many counts there are
    total, least = 0, 1
    for r in sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).collect(), key=lambda r: -r.s):
        total += r.c
        if total > HEAD:
            least = r.most + 1
            break
        least = r.least
    top = words.filter((F.col("n") >= least) & (F.col("word") != "")).collect()
    ends = words.filter("word = ''").first()
    head = {END: 0} | {w.encode(): i for i, w in enumerate(sorted(r.word for r in top), 1)}
    counts, kinds = np.zeros(len(head) + TAIL), np.zeros(len(head) + TAIL)
    counts[0], kinds[0] = (ends.n, 1) if ends else (0, 1)
    for r in top:
        counts[head[r.word.encode()]], kinds[head[r.word.encode()]] = r.n, 1
    found = Vocabulary(head, counts, kinds, n, v, tail := TAIL)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, k = np.zeros(tail, np.int64), np.zeros(tail, np.int64)
        for batch in batches:
            at = [xxhash.xxh64_intdigest(w.as_py()) % tail for w in batch.column(0).cast(pa.binary())]
            np.add.at(c, at, batch.column(1).to_numpy())
            np.add.at(k, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(tail), pa.int32()), pa.array(c), pa.array(k)], names=["c", "n", "k"])

    rare = words.filter((F.col("n") < least) & (F.col("word") != ""))
    for r in rare.mapInArrow(sums, "c int, n long, k long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect():
        counts[len(head) + r.c], kinds[len(head) + r.c] = r.n, r.k
    return found


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Rows of two kinds, written: a text's classes with its sums over head words, and its rare words (``word``, ``tf``), both with ``row``."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        logs = np.log10((voc.counts + 1) / (voc.n + voc.v + 1))
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "ids": pa.binary(), "n_tokens": pa.int64(), "head_known": pa.int64(), "head_base": pa.float64(), "word": pa.string(), "tf": pa.int64()}
        for batch in batches:
            texts, rare = [], []
            for row, doc_id, out, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()), strict=True):
                tokens = tokens_of(text.as_py())
                ids = [voc.head.get(w, -1) for w in tokens]
                tail = Counter()
                for i, c in enumerate(ids):
                    if c < 0:
                        ids[i] = voc.tail_class(tokens[i])
                        tail[tokens[i]] += 1
                array = np.array(ids, np.uint16)
                own = array[array < len(voc.head)]
                texts.append((row, doc_id, out, array.tobytes(), len(ids), int((voc.counts[own] > 0).sum()), float(logs[own].sum()), None, None))
                rare += [(row, None, None, None, None, None, None, w.decode(), tf) for w, tf in tail.items()]
                if len(rare) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*texts, *rare, strict=True), kinds.values(), strict=True)], names=list(kinds))
                    texts, rare = [], []
            if texts or rare:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*texts, *rare, strict=True), kinds.values(), strict=True)], names=list(kinds))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return common.written(rows.mapInArrow(read, "row long, doc_id long, held_out boolean, ids binary, n_tokens long, head_known long, head_base double, word string, tf long"), "lm-classes")


@dataclass
class Model:
    first: np.ndarray  # of states
    moves: np.ndarray  # from state (rows) to state
    emits: np.ndarray  # of classes (rows) by state (columns)


def side_by_side(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Batches of texts of like length, longest first: classes by step and text, texts still running at each step, their numbers."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    while order:
        steps = len(texts[order[0]])
        take = order[: max(1, min(WIDE, CELLS // max(steps, 1)))]
        order = order[len(take) :]
        ids = np.zeros((steps, len(take)), np.uint16)
        for k, i in enumerate(take):
            ids[: len(texts[i]), k] = texts[i]
        lengths = np.array([len(texts[i]) for i in take])
        yield ids, np.searchsorted(-lengths, -np.arange(steps), side="left"), take


def forward(model: Model, ids: np.ndarray, running: np.ndarray, start: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Scaled forward values after the steps of ``ids``; with ``keep`` those of every step. Scales are always returned.

    ``start`` has the values before the first step, None at the start of the texts.
    """
    values, held, scales = start, [], []
    for t in range(len(ids)):
        n = running[t]
        x = np.broadcast_to(model.first, (n, len(model.first))) if values is None else values[:n] @ model.moves
        x = x * model.emits[ids[t, :n]]
        c = x.sum(axis=1)
        values = x / c[:, None]
        scales.append(c)
        if keep:
            held.append(values)
    return values, held, scales


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each text's likelihood over its classes."""
    out = np.zeros(len(texts))
    for ids, running, take in side_by_side(texts):
        own, values = np.zeros(len(take)), None
        for a in range(0, len(ids), HELD_STEPS):
            values, _, scales = forward(model, ids[a : a + HELD_STEPS], running[a : a + HELD_STEPS], values)
            for c in scales:
                own[: len(c)] += np.log10(c)
        out[take] = own
    return out


class Expected:
    """Baum-Welch counts: of first states, moves and emissions."""

    def __init__(self, states: int, classes: int):
        self.first, self.moves, self.emits = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))

    def add(self, model: Model, texts: list[np.ndarray]) -> None:
        """Forward and backward over the texts. Of long ones only the forward values at block starts are held, and blocks run again backward."""
        k = len(self.first)
        for ids, running, _ in side_by_side(texts):
            starts, values = [], None
            cuts = list(range(0, len(ids), HELD_STEPS))
            for a in cuts:
                starts.append(values)
                if len(cuts) > 1:
                    values, _, _ = forward(model, ids[a : a + HELD_STEPS], running[a : a + HELD_STEPS], values)
            beta, after = np.ones((ids.shape[1], k)), None
            for a, start in zip(reversed(cuts), reversed(starts), strict=True):
                block, live = ids[a : a + HELD_STEPS], running[a : a + HELD_STEPS]
                _, held, scales = forward(model, block, live, start, keep=True)
                gammas = []
                for t in range(len(block) - 1, -1, -1):
                    if after is not None:  # the next step's emissions, backward values and scales
                        m = len(after)
                        self.moves += held[t][:m].T @ after
                        beta[:m] = after @ model.moves.T
                    gammas.append(held[t] * beta[: live[t]])
                    after = model.emits[block[t, : live[t]]] * beta[: live[t]] / scales[t][:, None]
                flat = np.concatenate([block[t, : live[t]] for t in range(len(block) - 1, -1, -1)])
                gamma = np.concatenate(gammas)
                for s in range(k):
                    self.emits[:, s] += np.bincount(flat, gamma[:, s], len(self.emits))
                if a == 0:
                    self.first += gammas[-1].sum(axis=0)

    def add_whole(self, model: Model, texts: list[np.ndarray]) -> None:
        """Counts as if no text ever left its first state; moves are not counted."""
        logs, first = np.log(model.emits), np.log(model.first)

        def chances(sums: np.ndarray) -> np.ndarray:
            out = np.exp(sums + first - (sums + first).max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            self.first += out.sum(axis=0)
            return out

        held: list[np.ndarray] = []
        n = 0
        for i, text in enumerate(texts):
            if len(text) > CELLS // 4:
                counts = np.bincount(text, minlength=len(logs))
                self.emits += counts[:, None] * chances((counts @ logs)[None])
            else:
                held.append(text)
                n += len(text)
            if held and (i + 1 == len(texts) or n > CELLS // 4):
                flat, lengths = np.concatenate(held), np.array([len(x) for x in held])
                p = chances(np.add.reduceat(logs[flat], np.cumsum(lengths) - lengths, axis=0))
                for s in range(len(first)):
                    self.emits[:, s] += np.bincount(flat, np.repeat(p[:, s], lengths), len(logs))
                held, n = [], 0

    def model(self, old: Model, words: Vocabulary) -> Model:
        """The next estimate. A class's counts are stretched to its smoothed count (one that no text has is shared as all others are), then all states get a little of the whole distribution."""
        smooth = words.smoothed()
        moves = (self.moves + 1e-3) * old.moves
        seen, share = self.emits.sum(axis=1), self.emits.sum(axis=0) / max(self.emits.sum(), 1e-12)
        stretched = np.where(seen[:, None] > 1e-9, self.emits * (smooth / np.maximum(seen, 1e-9))[:, None], smooth[:, None] * share)
        emits = stretched + PRIOR * smooth[:, None] / smooth.sum()
        first = self.first + 1e-3
        return Model(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def start(words: Vocabulary, states: int = STATES, seed: int = 11) -> Model:
    """The distribution of the whole training text in each state, but that each favours words of its own by draw; states are seldom left."""
    draw = np.random.default_rng(seed)
    emits = words.smoothed()[:, None] * draw.uniform(0.5, 1.5, (words.size, states)) if states > 1 else words.smoothed()[:, None]
    moves = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(axis=0))


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in column]


def train_round(rows: DataFrame, model: Model, words: Vocabulary, whole: bool = False) -> Model:
    """One round of Baum-Welch over ``rows`` (ids), or ``whole`` texts in one state each: tasks' counts are summed by block of classes."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    states, classes = len(model.first), words.size
    blocks = -(-classes // BLOCK)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Expected(states, classes)
        for batch in batches:
            (found.add_whole if whole else found.add)(held.value, _ids(batch.column(0)))
        data = [found.emits[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(blocks)]
        data.append(np.concatenate([found.first, found.moves.ravel()]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks + 1), pa.int32()), pa.array(data, pa.binary())], names=["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(data.as_py())
                sums[block] = sums[block] + counts if block in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    out = rows.select("ids").mapInArrow(expect, "block int, counts binary").repartition("block").mapInArrow(total, "block int, counts binary")
    found = Expected(states, classes)
    for r in out.collect():
        counts = np.frombuffer(bytes(r.counts))
        if r.block < blocks:
            found.emits[r.block * BLOCK : (r.block + 1) * BLOCK] += counts.reshape(-1, states)
        else:
            found.first += counts[:states]
            found.moves += counts[states:].reshape(states, states)
    return found.model(model, words)


def train(texts: DataFrame, words: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Rounds over all of written ``texts`` (ids): of the start, then of Baum-Welch."""
    model = start(words, states)
    for turn in range(START_ROUNDS + rounds if words.n else 0):
        model = train_round(texts, model, words, whole=turn < START_ROUNDS)
    return model


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    A null text counts as empty (its end alone), a null id as empty text for the
    fold. Without training texts every word has the base probability 1 / 1.
    """
    spark = docs.sparkSession
    counts = docs.filter(~held_out()).select("text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.written(counts, "lm-words")
    words = vocabulary(counts)
    both = encode(docs, words)
    texts, rare = both.filter("word IS NULL"), both.filter("word IS NOT NULL").select("row", "word", "tf")
    model = train(texts.filter(~F.col("held_out")).select("doc_id", "ids", "n_tokens"), words, states, rounds)
    held, smooth = spark.sparkContext.broadcast(model), np.log10(words.smoothed())[len(words.head) :]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column("ids"))
            found = log_likelihoods(held.value, ids)
            # A rare word's share of its class: (c + 1) / smoothed count; the numerator is joined.
            shared = [smooth[x[x >= len(words.head)].astype(np.int64) - len(words.head)].sum() for x in ids]
            keep = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found - np.array(shared, np.float64), pa.float64())], names=[*keep, "likelihood"])

    likely = texts.select("row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "ids").mapInArrow(read, "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, likelihood double")
    least = F.log10(F.lit(float(words.n + words.v + 1)))
    more = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) * F.col("tf")
    tail = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(more).alias("_log"), F.sum("tf").alias("_tf"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = likely.join(tail, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("_known")).alias("n_known"), F.lit(int(words.n)).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("_log") - zero("_tf") * least).alias("base_score"), (F.col("likelihood") + zero("_log")).alias("score"),
    )


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, by ``score``: null and empty texts are their end alone, a text of any length is scored whole, repeated rows score alike, an empty table gives an empty result, other columns are not read."""
    return score(common.documents(spark, sf_dir))
