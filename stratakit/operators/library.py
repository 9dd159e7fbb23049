"""A library's own reads: document filters and groups, queues, page trees, labels and answers, as composable DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.sources.scratch import settled

# Fixed values of the reads: the least probability of a label, bytes a page and pages of a thin text, equations named around one, headings of an outline.
LABEL_P = 0.5
THIN_BYTES, THIN_PAGES = 100, 5
EQUATIONS_BEFORE, EQUATIONS_AFTER = 2, 3
OUTLINE, EARLIER_TEXTS, MEDIA_PAGE = 20, 10, 40


def live(retired: Column) -> Column:
    return retired.isNull()


def doctype(mime: Column, kind: Column) -> Column:
    """What a reader calls a document: note and page by its kind, else by its MIME type."""
    return (
        F.when(kind == "page", "page").when(kind == "note", "note").when(mime == "application/pdf", "pdf").when(mime.startswith("text/html"), "web")
        .when(mime.startswith("video/"), "video").when(mime.startswith("image/"), "image").otherwise("text")
    )


def text_window(docs: DataFrame, offset: int, n: int) -> DataFrame:
    """``n`` characters of each text from ``offset`` on, its whole length, and whether more follows."""
    return docs.select("doc_id", F.substring("text", offset + 1, n).alias("part"), F.length("text").alias("length"), (F.length("text") > offset + n).alias("more"))


def batch(docs: DataFrame, where: list[Column], limit: int | None = None) -> DataFrame:
    """Documents that meet all conditions, oldest first."""
    for condition in where:
        docs = docs.filter(condition)
    ordered = docs.orderBy("doc_id")
    return ordered.limit(limit) if limit else ordered


def within(tree: DataFrame, rounds: int = 30) -> DataFrame:
    """(name, ancestor) for every node of ``tree`` (name, parent), itself included; a step of the frontier a round, in a tree."""
    front = tree.select("name", F.col("name").alias("ancestor"), F.col("parent").alias("_up"))
    parents = tree.select(F.col("name").alias("_n"), F.col("parent").alias("_p"))
    out = front.select("name", "ancestor")
    for _ in range(rounds):
        front = front.filter("_up IS NOT NULL").join(parents, F.col("_up") == F.col("_n")).select("name", F.col("_up").alias("ancestor"), F.col("_p").alias("_up"))
        front = settled(front, "ancestors")
        if front.isEmpty():
            return out
        out = out.unionByName(front.select("name", "ancestor"))
    raise RuntimeError(f"a tree deeper than {rounds} steps, or a cycle")


def domain_counts(docs: DataFrame, tree: DataFrame) -> DataFrame:
    """(domain, own, within): documents (doc_id, domains) of each domain, and of it with all below it; documents without one count under null."""
    each = docs.select("doc_id", F.explode_outer("domains").alias("name"))
    own = each.groupBy(F.col("name").alias("domain")).agg(F.count("*").alias("own"))
    inside = each.join(within(tree), "name").groupBy(F.col("ancestor").alias("domain")).agg(F.count_distinct("doc_id").alias("within"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = own.withColumnRenamed("domain", "_d").join(inside, F.col("_d") == F.col("domain"), "full")
    return both.select(F.coalesce("domain", "_d").alias("domain"), zero("own"), zero("within"))


def share_by(rows: DataFrame, key: str, item: str, group: str) -> DataFrame:
    """(key, group, n, share): distinct items of each key by group."""
    counts = rows.select(key, item, group).distinct().groupBy(key, group).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def outline(passages: DataFrame, limit: int = OUTLINE) -> DataFrame:
    """(doc_id, place, heading): a document's distinct headings in the order they first stand in."""
    first = passages.filter("heading IS NOT NULL").groupBy("doc_id", "heading").agg(F.min("seq").alias("_seq"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("_seq", "heading"))).filter(F.col("place") <= limit).drop("_seq")


def sure_labels(given: Column, at_least: float = LABEL_P) -> Column:
    """Names of the labels (name, p) whose probability is high enough, the likeliest first."""
    kept = F.filter(given, lambda x: x["p"] >= at_least)
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct((-x["p"]).alias("p"), x["name"].alias("name")))), lambda x: x["name"])


def media_groups(rows: DataFrame, group: Column, states: list[str]) -> DataFrame:
    """Counts of each group by state, and in all."""
    out = rows.groupBy(group.alias("grp")).pivot("state", states).agg(F.count(F.lit(1)))
    counts = [F.coalesce(s, F.lit(0)).alias(s) for s in states]
    return out.select("grp", *counts, sum((F.coalesce(F.col(s), F.lit(0)) for s in states), F.lit(0)).alias("n"))


def weighted_evidence(evidence: DataFrame, weights: dict[str, float], passed: DataFrame, limit: int) -> DataFrame:
    """(doc_id, score): documents that ``evidence`` (doc_id, kind, n) speaks for, less those in ``passed``, by weight."""
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in weights.items()], F.lit(0.0))
    scored = evidence.join(passed.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.sum(weight * F.col("n")).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(limit)


def thin(docs: DataFrame, per_page: int = THIN_BYTES, min_pages: int = THIN_PAGES) -> DataFrame:
    """Documents (doc_id, pages, bytes) of enough pages whose text is under ``per_page`` bytes a page."""
    held = docs.filter((F.col("pages") >= min_pages) & (F.col("bytes") / F.col("pages") < per_page))
    return held.withColumn("per_page", F.floor(F.col("bytes") / F.col("pages")))


def findings(docs: DataFrame) -> DataFrame:
    """(finding, n, first) over documents (doc_id, findings: array)."""
    return docs.select("doc_id", F.explode("findings").alias("finding")).groupBy("finding").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def earlier_texts(docs: DataFrame, limit: int = EARLIER_TEXTS) -> DataFrame:
    """(doc_id, place, version) of the texts before the current one, the latest first; ``history`` is an array of (at, version)."""
    every = docs.select("doc_id", F.explode("history").alias("h")).select("doc_id", "h.*")
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("version"))) - 1)
    return placed.filter(F.col("place").between(1, limit))


def request(wanted: DataFrame, waiting: DataFrame, keys: list[str]) -> DataFrame:
    """Requests to place: each wanted key once, but those that wait already."""
    return wanted.select(*keys).distinct().join(waiting.select(*keys).distinct(), keys, "left_anti")


def due(rows: DataFrame, requested: DataFrame, version: int) -> DataFrame:
    """Documents (doc_id, stamp) read under an older version or never, or asked for again; ``first`` marks those asked for."""
    asked = requested.select("doc_id").distinct().withColumn("_asked", F.lit(True))
    out = rows.join(asked, "doc_id", "left").withColumn("first", F.coalesce("_asked", F.lit(False))).drop("_asked")
    return out.filter(F.col("first") | F.col("stamp").isNull() | (F.col("stamp") < version))


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group."""
    backwards = [c.desc() for c in order]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*backwards))).filter("_r = 1").drop("_r")


def preferred(labels: DataFrame) -> DataFrame:
    """Labels (id, entity, lang, kind) with one preferred label in each language, the newest; older preferred ones become alternatives."""
    w = Window.partitionBy("entity", "lang", "kind").orderBy(F.desc("id"))
    demoted = (F.col("kind") == "pref") & (F.row_number().over(w) > 1)
    return labels.withColumn("_d", demoted).withColumn("kind", F.when(F.col("_d"), "alt").otherwise(F.col("kind"))).drop("_d")


def shown_names(labels: DataFrame, order: list[str]) -> DataFrame:
    """(entity, shown): the label of the first language of ``order`` that an entity is named in, preferred before others, the oldest of equals."""
    rank = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(i)) for i, lang in enumerate(order)], F.lit(len(order)))
    return labels.groupBy("entity").agg(F.min_by("label", F.struct(rank.alias("r"), (F.col("kind") != "pref").alias("k"), "id")).alias("shown"))


def unlabelled(entities: DataFrame, labels: DataFrame, lang: str) -> DataFrame:
    """Entities (id, uses) without a label in a language, the most used first."""
    return entities.join(labels.filter(F.col("lang") == lang).select(F.col("entity").alias("id")).distinct(), "id", "left_anti").orderBy(F.desc("uses"), "id")


def shared_names(entities: DataFrame, related: DataFrame) -> DataFrame:
    """(name, types): names (name, type) that several types share; a pair of types that ``related`` (a, b) says are one kind does not count."""
    each = entities.select(F.lower("name").alias("name"), "type").distinct()
    pairs = each.join(each.select("name", F.col("type").alias("other")), "name").filter("type < other")
    odd = pairs.join(related, (F.col("type") == F.col("a")) & (F.col("other") == F.col("b")), "left_anti")
    return odd.select("name", F.explode(F.array("type", "other")).alias("type")).groupBy("name").agg(F.array_sort(F.collect_set("type")).alias("types"))


def sole_language(uses: DataFrame) -> DataFrame:
    """(entity, lang): entities (entity, lang) that are named in one language alone."""
    return uses.groupBy("entity").agg(F.min("lang").alias("lang"), F.count_distinct("lang").alias("_n")).filter("_n = 1").drop("_n")


def stale_summaries(groups: DataFrame, limit: int) -> DataFrame:
    """Communities (id, level, size, changed, summarised) without a summary or changed since, the upper level and the largest first."""
    return groups.filter("summarised IS NULL OR summarised < changed").orderBy("level", F.desc("size"), "id").limit(limit)
