"""Snippets, passage ranking, merged lists, line rules and grouped items, as Column expressions and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.operators import documents as D
from stratakit.operators import search as S


def snippet(text: Column, terms: list[str], n: int, before: int) -> Column:
    """``n`` words of a text from ``before`` words before its first hit on, hits in brackets, an ellipsis where something is left out."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]+", ""))
    marked = F.transform(words, lambda w: F.struct(w.alias("w"), bare(w).isin(terms).alias("hit")))

    def cut(m: Column) -> Column:
        first = F.array_min(F.filter(F.transform(m, lambda x, i: F.when(x["hit"], i)), lambda i: i.isNotNull()))
        a = F.greatest(F.lit(0), F.coalesce(first, F.lit(0)) - before)
        part = F.transform(F.slice(m, a + 1, n), lambda x: F.when(x["hit"], F.concat(F.lit("["), x["w"], F.lit("]"))).otherwise(x["w"]))
        return F.concat(F.when(a > 0, "…").otherwise(""), F.array_join(part, " "), F.when(a + n < F.size(m), "…").otherwise(""))

    # The words are bound once, or each use would cut the text again.
    return F.element_at(F.transform(F.array(marked), cut), 1)


def best_of(lists: list[DataFrame], key: str, depth: int) -> DataFrame:
    """Several lists (key, score) as one, each key by its best score."""
    return reduce(DataFrame.unionByName, lists).groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(depth)


def passage_bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, seq, score) of the passages that hold a term, by BM25 over passages."""
    passages = D.chunks(docs).select(F.struct("doc_id", F.col("seq").cast("long").alias("seq")).alias("at"), "text")
    return S.bm25(passages, terms, key="at").select("at.doc_id", "at.seq", "score")


def grouped(rows: DataFrame, gap_seconds: int, apart: list[str]) -> DataFrame:
    """Events with ``group``: runs of a user's items with gaps below ``gap_seconds`` and equal values of ``apart``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    new = seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w) >= gap_seconds
    for c in apart:
        new = new | (F.col(c) != F.lag(c).over(w))
    return rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def carried(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new, old, verdict): decisions on old groups (old, member, verdict) that new ones (new, member) inherit: more than half of their members were there."""
    sizes = new.groupBy("new").agg(F.count("*").alias("_k"))
    both = new.join(old, "member").groupBy("new", "old").agg(F.first("verdict").alias("verdict"), F.count("*").alias("_c"))
    return both.join(sizes, "new").filter(2 * F.col("_c") > F.col("_k")).select("new", "old", "verdict")


def fold_versions(hits: DataFrame) -> DataFrame:
    """Hits (doc_id, place, work) with all versions of a work as its latest, at the best place; at most the hits' depth of rows."""
    w = Window.partitionBy("work")
    latest = hits.withColumn("_l", F.max("doc_id").over(w))
    older = F.array_join(F.array_sort(F.collect_list(F.when(F.col("doc_id") != F.col("_l"), F.col("doc_id")))).cast("array<string>"), " ")
    return latest.groupBy("_l").agg(F.min("place").alias("place"), older.alias("older")).withColumnRenamed("_l", "doc_id")


def contents_line(line: Column) -> Column:
    """Does a line end in leaders and a page, number a heading with a page, or list a term's pages?"""
    return line.rlike(r"[.…]{3,} *[0-9]+$") | line.rlike(r"^[0-9]+([.][0-9]+)* .*[^0-9][0-9]{1,3}$") | line.rlike(r"^[^,]+(, [0-9]+)+$")


def line_windows(docs: DataFrame, target: int) -> DataFrame:
    """(doc_id, nr, part): each line's number and the window of ``target`` characters that it begins in."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("nr", "line"))
    w = Window.partitionBy("doc_id").orderBy("nr")
    start = F.sum(F.length("line") + 1).over(w) - F.length("line") - 1
    return lines.withColumn("part", F.floor(start / target)).select("doc_id", "nr", "part")


def dated_sentences(docs: DataFrame, least: int = 30) -> DataFrame:
    """(doc_id, sentence): sentences of some length that name a year and hold no citation mark."""
    each = docs.select("doc_id", F.explode(F.split("text", r"(?<=[.!?])")).alias("sentence")).filter(F.col("sentence").rlike("^[^.!?]+[.!?]$"))
    return each.filter(F.col("sentence").rlike(r"\b(1[0-9]{3}|20[0-9]{2})\b") & (F.length(F.trim("sentence")) >= least) & ~F.col("sentence").rlike(r"\[[0-9]+\]"))


def negated(text: Column, word: str, cues: list[str], within: int) -> Column:
    """Does a cue stand before ``word``, with at most ``within`` words between?"""
    return F.lower(text).rlike(rf"\b({'|'.join(cues)})((?: [a-z]+){{0,{within}}}) {word}\b")
