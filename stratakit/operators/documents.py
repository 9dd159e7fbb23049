"""Listing, filters and facets over document tables: composable predicates and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.sources.scratch import settled


def title_contains(title: Column, words: str) -> Column:
    """Case-insensitive literal match."""
    return F.contains(F.lower(title), F.lower(F.lit(words)))


def holds_domain(domains: Column, names: list[str], unset: bool) -> Column:
    """Does an array of domains hold one of ``names``? An empty or null one counts as ``unset`` says."""
    none = domains.isNull() | (F.size(domains) == 0)
    return F.when(none, F.lit(unset)).otherwise(F.arrays_overlap(domains, F.array(*map(F.lit, names))))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def first_rule(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The outcome of the first rule whose condition holds."""
    case = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    return case.otherwise(F.lit(default))


def shared_titles(rows: DataFrame, title: str, at_least: int) -> DataFrame:
    return rows.groupBy(title).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") >= at_least)


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """(doc_id, seq, start, end, text): fixed windows over each text."""
    return docs.select("doc_id", F.inline(T.windows(F.col("text"), size, overlap)))


def read_on(passages: DataFrame, after: int, budget: int) -> DataFrame:
    """Passages after ``after`` of each document within a budget of characters; the first one always."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    rest = passages.filter(F.col("seq") > after)
    rest = rest.withColumn("_sum", F.sum(F.length("text")).over(w)).withColumn("_rn", F.row_number().over(w))
    return rest.filter((F.col("_sum") <= budget) | (F.col("_rn") == 1)).drop("_sum", "_rn")


def best_chunk(passages: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, seq, score): the passage whose matched distinct tokens are longest in all; the earliest of equals."""
    held = F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, words)))
    score = F.aggregate(held, F.lit(0), lambda a, t: a + F.length(t))
    scored = passages.select("doc_id", "seq", score.alias("score"))
    return scored.groupBy("doc_id").agg(F.min_by("seq", F.struct((-F.col("score")).alias("s"), "seq")).alias("seq"), F.max("score").alias("score"))


def neighbours(rows: DataFrame, key: str, order: str, at: Column, before: int, after: int) -> DataFrame:
    """Rows from ``before`` places before to ``after`` places after each row that ``at`` marks, by group."""
    w = Window.partitionBy(key).orderBy(order)
    placed = rows.withColumn("_p", F.row_number().over(w)).withColumn("_at", at)
    near = Window.partitionBy(key).orderBy("_p").rowsBetween(-after, before)
    return placed.withColumn("_near", F.max(F.col("_at").cast("int")).over(near)).filter("_near = 1").drop("_p", "_at", "_near")


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row that changes when any row does, whatever their order: count and sum of row hashes."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")).alias("checksum"))


def pivot_counts(rows: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """Counts of each value side by side."""
    out = rows.groupBy(key).pivot(by, values).agg(F.count(F.lit(1)))
    return out.select(key, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def published(sources: list[Column]) -> Column:
    """The first date that is there, in order of trust."""
    return F.coalesce(*sources)


def current_of(redirects: DataFrame, rounds: int = 20) -> DataFrame:
    """(doc_id, current): where each retired document's redirects end; pointers double in each round; a document that redirects to itself stays, a longer cycle is an error."""
    at = redirects.select("doc_id", F.col("replaced_by").alias("current"))
    for _ in range(rounds):
        step = at.select(F.col("doc_id").alias("_id"), F.col("current").alias("_next"))
        at = at.join(step, F.col("current") == F.col("_id"), "left").select("doc_id", F.coalesce("_next", "current").alias("current"), (F.col("_next").isNotNull() & (F.col("_next") != F.col("current"))).alias("_more"))
        at = settled(at, "redirects")
        more = at.filter("_more").limit(1).count()
        at = at.drop("_more")
        if not more:
            return at
    raise RuntimeError(f"redirects in a cycle, or a chain longer than 2 ** {rounds}")


def single_copies(places: DataFrame, held: DataFrame) -> DataFrame:
    """Files that stand in one place only and are not held: what a loss would take."""
    once = places.filter("gone IS NULL").groupBy("sha256").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max("size").alias("size")).filter("n = 1")
    return once.join(held, once["sha256"] == held["hash"], "left_anti").select("sha256", "path", "size")


def duplicate_places(places: DataFrame, min_size: int = 0) -> DataFrame:
    """Content in several places with the bytes a single copy would save."""
    groups = places.filter(F.col("gone").isNull() & (F.col("size") >= min_size)).groupBy("sha256").agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    return groups.filter("copies > 1").withColumn("wasted", F.col("size") * (F.col("copies") - 1))


def keep_latest(held: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert: of rows with equal keys the one with the greatest version, a new one before a held one."""
    both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_new")


def behind(rows: DataFrame, stamps: DataFrame, keys: list[str], current: str) -> DataFrame:
    """Rows that no stamp of the current producer covers."""
    return rows.join(stamps.filter(F.col("stamp") == current), keys, "left_anti")
