"""Keyword and vector search: inverted index, BM25, exact nearest neighbours, rank fusion.

A stored index has postings ranged by term; a query reads only those of its own
terms. Every ranked list has a total order, so results are stable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.sources.scratch import settled

# Fixed values of the search: BM25's parameters and rank fusion's constant.
K1, B = 1.2, 0.75
RRF_K = 60
#: Hits of each list that are fused at least.
RRF_DEPTH = 100
STALE_SHIFT = 5.5
PRIOR_DEPTH, PRIOR_MIN, PRIOR_SHARE = 30, 3, 0.2


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf): how often each term stands in each text."""
    return docs.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.size(T.tokens(F.col(text))).cast("long").alias("dl"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda t: t == word


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5)): never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def counted(tokens: Column) -> Column:
    """(term, tf) of a text's tokens: counts of equal neighbours in their order."""
    bound = lambda of, then: F.element_at(F.transform(F.array(of), then), 1)

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(starts, lambda p: F.transform(p, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(p, j + 1), F.size(s)) - at).cast("long").alias("tf"))))

    return bound(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, runs(s)))


def stored_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, tf, dl) and the one row of statistics (_n, _avg) of texts read from files, as tables in the shared folder.

    A task counts the words of its own texts and writes their postings in the
    order of terms: nothing is shuffled, and a query reads of each file only the
    parts that may hold its terms. They are built once in an application for a set
    of files with their sizes and times; files that change are indexed anew.
    """
    spark = docs.sparkSession
    stamp = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    stamp = stamp.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    mark = (spark.sparkContext.applicationId, key, text, *stamp)
    if mark not in _indexes:
        words = docs.select(key, F.element_at(F.transform(F.array(T.tokens(F.col(text))), lambda t: F.struct(F.size(t).alias("dl"), counted(t).alias("t"))), 1).alias("_w"))
        index = words.select(key, F.col("_w.dl").alias("dl"), F.inline("_w.t")).select("term", key, "dl", "tf")
        index = settled(index.sortWithinPartitions("term"), "postings")
        n = docs.agg(F.count("*").alias("_n"))
        stats = index.agg(F.sum("tf").alias("_all")).join(n).select("_n", (F.coalesce("_all", F.lit(0)) / F.nullif(F.col("_n"), F.lit(0))).alias("_avg"))  # one row each
        _indexes[mark] = index, settled(stats, "index-statistics")
    return _indexes[mark]


_indexes: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def bm25_stored(index: tuple[DataFrame, DataFrame], terms: list[str], key: str = "doc_id", all_terms: bool = False) -> DataFrame:
    """As ``bm25``, from a stored index: only the postings of the terms are read."""
    postings, stats = index
    words = sorted(set(terms))
    held = postings.filter(F.col("term").isin(words))
    n, mean = stats.first()
    df = held.groupBy("term").agg(F.count("*").alias("df"))  # a row a term of the query
    parts = idf(F.lit(n), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    out = held.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(parts).alias("score"), F.count("*").alias("n_terms"))
    return out.filter(F.col("n_terms") == len(words)) if all_terms else out


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", all_terms: bool = False) -> DataFrame:
    """(key, score, n_terms) of every text that holds a term (all of them with ``all_terms``).

    One scan keeps the counts of the query's own terms per text; the terms'
    frequencies and the mean length are one row, joined without a shuffle.
    """
    words = sorted(set(terms))
    read = docs.select(key, T.tokens(F.col(text)).alias("_t"))
    read = read.select(key, F.size("_t").alias("_dl"), *[F.size(F.filter("_t", _equals(w))).alias(f"_tf{i}") for i, w in enumerate(words)])
    stats = read.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(words))])
    held = read.filter(sum((F.col(f"_tf{i}") for i in range(len(words))), F.lit(0)) > 0).join(F.broadcast(stats))  # one row
    norm = K1 * (1 - B + B * F.col("_dl") / F.col("_avg"))
    parts = [idf(F.col("_n"), F.col(f"_df{i}")) * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + norm) for i in range(len(words))]
    found = sum((F.when(F.col(f"_tf{i}") > 0, 1).otherwise(0) for i in range(len(words))), F.lit(0))
    out = held.select(key, sum(parts, F.lit(0.0)).alias("score"), found.cast("long").alias("n_terms"))
    return out.filter(F.col("n_terms") == len(words)) if all_terms else out


def bm25_batch(index: tuple[DataFrame, DataFrame], queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query, key, score) for many queries (query, term) at once: their terms meet the postings once.

    Postings of their terms are shuffled by text, and meet the queries there if
    these are few enough to be sent to all tasks, so that no score is shuffled.
    """
    postings, stats = index
    n, mean = stats.first()
    asked = settled(queries.distinct(), "queries")
    held = postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    asked = settled(asked.join(df, "term"), "query-terms")
    parts = idf(F.lit(n), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    return held.repartition(key).join(asked, "term").groupBy("query", key).agg(F.sum(parts).alias("score"))


def phrase(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n) of texts that hold the words in this order beside each other."""
    joined = F.concat(F.lit(" "), F.array_join(T.tokens(F.col(text)), "  "), F.lit(" "))
    wanted = " " + "  ".join(words) + " "
    count = (F.length(joined) - F.length(F.replace(joined, F.lit(wanted), F.lit("")))) / len(wanted)
    return docs.select(key, count.cast("long").alias("n")).filter("n > 0")


def top(ranked: DataFrame, n: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    return ranked.orderBy(F.desc(score), key).limit(n)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Query vectors compared at a time, and vectors they are compared with at a time.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 1024


def _nearest(ids: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``found`` the k greatest, of equal ones those with the least id."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, found = np.take_along_axis(ids, order, 1), np.take_along_axis(found, order, 1)
    best = np.argsort(-found, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, best, 1), np.take_along_axis(found, best, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    if column.null_count:
        return np.array(column.to_pylist(), np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearer(best: np.ndarray, scores: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``_nearest`` of the rows held (``best``, ``scores``, sorted so) and those of ``ids`` with no nan in ``score``: only scores that reach a row's last place are sorted."""
    least = scores[:, -1] if scores.shape[1] == k else np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
    row, at = np.nonzero(score >= least[:, None])
    if not len(row):
        return best, scores
    held, width = np.repeat(np.arange(len(best)), best.shape[1]), min(k, best.shape[1] + score.shape[1])
    row, i, x = np.concatenate([held, row]), np.concatenate([best.ravel(), ids[at]]), np.concatenate([scores.ravel(), score[row, at]])
    order = np.lexsort((i, -x, row))
    row, i, x = row[order], i[order], x[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return i[place < k].reshape(len(best), width), x[place < k].reshape(len(best), width)


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, similarity, place): the k nearest of each query vector by cosine, exactly.

    Queries (query, q) go out in blocks of ``QUERY_BLOCK``; each block reads the
    vectors once, and nothing but the k best of each partition is shuffled.
    """
    spark, n = vectors.sparkSession, queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", F.col("q").cast("array<double>").alias("q")).toArrow()
        asked = block.column("query").to_numpy()
        matrix = _matrix(block.column("q").combine_chunks())
        held = spark.sparkContext.broadcast((asked, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))

        def compare(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            asked, matrix = held.value
            best, scores = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0))
            for batch in batches:
                for at in range(0, batch.num_rows, VECTOR_BLOCK):
                    part = batch.slice(at, VECTOR_BLOCK)
                    own = _matrix(part.column(1))
                    # Equal vectors must score equally whatever their place in the block.
                    score = matrix @ (own / np.linalg.norm(own, axis=1, keepdims=True)).T
                    score = np.round(score, 12, out=score)
                    ids, whole = part.column(0).to_numpy(), not (np.isnan(score[:, :1]).any() or np.isnan(score[:1]).any() or np.isnan(scores).any())
                    if whole:
                        best, scores = _nearer(best, scores, ids, score, k)
                    else:
                        best, scores = _nearest(np.concatenate([best, np.broadcast_to(ids, score.shape)], axis=1), np.concatenate([scores, score], axis=1), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, best.shape[1])), pa.array(best.ravel()), pa.array(scores.ravel())], names=["query", key, "similarity"])

        if len(asked):
            found.append(vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).mapInArrow(compare, f"query long, {key} long, similarity double"))
    if not found:
        return spark.createDataFrame([], f"query long, {key} long, similarity double, place int")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def fuse(lists: list[tuple[DataFrame, float]], key: str = "doc_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of (DataFrame with key, place), in the lists' order.

    ``place`` counts distinct keys from 1. Score is the sum of weight / (60 +
    place). Ties keep first-seen order: the first list that has the key, its
    place there, the key.
    """
    rows = [frame.select(key, "place", F.lit(i).alias("list"), F.lit(float(w)).alias("w")) for i, (frame, w) in enumerate(lists)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    first = F.min(F.struct("list", "place"))
    fused = every.groupBy(key).agg(F.sum(F.col("w") / (RRF_K + F.col("place"))).alias("score"), first.alias("_f"), F.count("*").alias("n_lists"))
    return fused.select(key, "score", "n_lists", F.col("_f.list").alias("first_list"), F.col("_f.place").alias("first_place"))


def places(ranked: DataFrame, depth: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The best ``depth`` of a list with their places."""
    best = top(ranked, depth, score, key)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), key)))  # at most ``depth`` rows


def field_weight(n_words: int) -> float:
    """2 up to three words of a query, falling to 1 at seven."""
    return 2.0 if n_words <= 3 else max(1.0, 2 - (n_words - 3) / 4)


def shift_stale(hits: DataFrame) -> DataFrame:
    """``place`` after stale hits are moved back, others keeping their order; (doc_id, place, stale) with at most the hits' depth of rows."""
    order = Window.orderBy(F.col("place") + F.when(F.col("stale"), STALE_SHIFT).otherwise(0.0), "place")
    return hits.withColumn("new_place", F.row_number().over(order))


def domain_prior(hits: DataFrame, library: DataFrame) -> DataFrame:
    """Add a vote for the one domain that stands out among the best hits.

    ``hits`` (doc_id, score, place, domain), ``library`` (domain, share). A
    domain with at least three of the first 30 hits and less than a fifth of the
    library, if it is the only one with the most, adds 1 / (60 + k) to its k-th
    hit.
    """
    votes = hits.filter(F.col("place") <= PRIOR_DEPTH).groupBy("domain").agg(F.count("*").alias("votes"))
    votes = votes.join(library.filter(F.col("share") < PRIOR_SHARE), "domain").filter(F.col("votes") >= PRIOR_MIN)
    ranked = votes.withColumn("_r", F.rank().over(Window.orderBy(F.desc("votes")))).filter("_r = 1")  # a row a domain
    sole = ranked.groupBy("_r").agg(F.count("*").alias("_n"), F.min("domain").alias("voted")).filter("_n = 1").select("voted")
    out = hits.join(F.broadcast(sole), F.col("domain") == F.col("voted"), "left")
    k = F.row_number().over(Window.partitionBy("voted").orderBy("place"))
    return out.withColumn("prior", F.when(F.col("voted").isNotNull(), 1 / (RRF_K + k)).otherwise(F.lit(0.0)))


def _alone(passages: list[tuple[int, list[str]]], n: int) -> Iterator[tuple[int, str]]:
    """(chunk, phrase) of one document's passages (chunk, words): the first run of n words that no other chunk holds."""
    held: dict[tuple[str, ...], tuple[int | None, int]] = {}
    for chunk, words in passages:
        for at, run in enumerate(zip(*(words[i:] for i in range(n)), strict=False)):
            known = held.get(run)
            if known is None:
                held[run] = chunk, at
            elif known[0] != chunk:
                held[run] = None, at
            elif at < known[1]:
                held[run] = chunk, at
    first: dict[int, tuple[int, str]] = {}
    for run, (chunk, at) in held.items():
        if chunk is not None and (chunk not in first or (at, " ".join(run)) < first[chunk]):
            first[chunk] = at, " ".join(run)
    return ((chunk, phrase) for chunk, (_, phrase) in first.items())


def unique_phrases(chunks: DataFrame, n: int) -> DataFrame:
    """(doc_id, chunk, phrase): the first run of n words of a passage that no other passage of its document holds.

    Passages are dealt by document; a task holds the runs of one document at a time.
    """
    words = chunks.select("doc_id", "chunk", "text").filter("chunk IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id")
    words = words.select("doc_id", F.col("chunk").cast("long").alias("chunk"), T.tokens(F.col("text")).alias("_t"))
    kind = words.schema["doc_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, passages, out = None, [], []
        for batch in batches:
            for doc, chunk, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if passages and doc != own:
                    out += [(own, *x) for x in _alone(passages, n)]
                    passages = []
                own = doc
                if len(t) >= max(n, 8):
                    passages.append((chunk, t))
            if out:
                yield made(out, batch.schema.field(0).type)
                out = []
        if passages:
            yield made([(own, *x) for x in _alone(passages, n)], batch.schema.field(0).type)

    def made(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        docs, own, phrases = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(docs, of), pa.array(own, pa.int64()), pa.array(phrases, pa.string())], names=["doc_id", "chunk", "phrase"])

    return words.mapInArrow(read, f"doc_id {kind.simpleString()}, chunk long, phrase string")


def evaluate(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Hit rates and mean reciprocal rank. ``ranked`` (query, doc_id, place), ``expected`` (query, doc_id)."""
    best = expected.join(ranked, ["query", "doc_id"], "left").groupBy("query").agg(F.min("place").alias("p"))
    hit = lambda k: F.avg(F.when(F.col("p") <= k, 1.0).otherwise(0.0))
    return best.agg(F.count("*").alias("queries"), hit(1).alias("hit1"), hit(3).alias("hit3"), F.avg(F.coalesce(1.0 / F.col("p"), F.lit(0.0))).alias("mrr"))
