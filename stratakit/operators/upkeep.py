"""Retiring and restoring, imports and exports, merges under review and other upkeep of a library, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T

# Ligatures and signs of typeset texts with what they stand for.
GLYPHS = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "’": "'", "“": '"', "”": '"', "­": "", " ": " "}


def retired(edges: DataFrame, documents: DataFrame, at: str) -> DataFrame:
    """Edges with those of the ``documents`` (doc_id) ended; what has ended before stays as it is."""
    gone = documents.select(F.col("doc_id").alias("source_doc")).distinct().withColumn("_gone", F.lit(True))
    return edges.join(gone, "source_doc", "left").withColumn("valid_to", F.coalesce("valid_to", F.when(F.col("_gone"), F.lit(at)))).drop("_gone")


def restored(edges: DataFrame, documents: DataFrame, at: str) -> DataFrame:
    """Edges of the ``documents`` that their retirement at ``at`` ended, open again."""
    back = documents.select(F.col("doc_id").alias("source_doc")).distinct().withColumn("_back", F.lit(True))
    return edges.join(back, "source_doc", "left").withColumn("valid_to", F.when(~(F.coalesce("_back", F.lit(False)) & (F.col("valid_to") == at)), F.col("valid_to"))).drop("_back")


def cleanup_set(docs: DataFrame, key: Column) -> DataFrame:
    """(doc_id, first): documents whose text stands in an older one, which stays."""
    return docs.withColumn("first", F.min("doc_id").over(Window.partitionBy(key))).filter("doc_id <> first").select("doc_id", "first")


def as_lines(edges: DataFrame, columns: list[str]) -> DataFrame:
    """Edges as JSON, one line each."""
    return edges.select("id", F.to_json(F.struct(*columns)).alias("line"))


def from_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Edges read back from JSON lines; a line that is none has only nulls and is left out."""
    return lines.select(F.from_json("line", schema).alias("e")).select("e.*").filter("id IS NOT NULL")


def landed(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, state): foreign edges to import: in if both ends (gid, how) have landed, held while one is only likely, new otherwise."""
    a, b = ends.select(F.col("gid").alias("src"), F.col("how").alias("_a")), ends.select(F.col("gid").alias("dst"), F.col("how").alias("_b"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    likely = (F.col("_a") == "likely") | (F.col("_b") == "likely")
    sure = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.select("id", F.when(likely, "held").when(sure, "in").otherwise("new").alias("state"))


def standing(decisions: DataFrame, by: list[str]) -> DataFrame:
    """The last decision of each key that was not taken back; ``decisions`` (by, at, verdict), verdict ``undo`` takes back what stood."""
    w = Window.partitionBy(*by).orderBy(F.desc("at"))
    return decisions.withColumn("_r", F.row_number().over(w)).filter("_r = 1 AND verdict <> 'undo'").drop("_r")


def shared_context(members: DataFrame, doc: int, limit: int) -> DataFrame:
    """(doc, shared): documents that share most entities with one."""
    own = members.filter(F.col("doc") == doc).select("entity").distinct()
    near = members.filter(F.col("doc") != doc).distinct().join(own, "entity", "left_semi").groupBy("doc").agg(F.count("*").alias("shared"))
    return near.orderBy(F.desc("shared"), "doc").limit(limit)


def leading_phrases(counts: DataFrame, times: float) -> DataFrame:
    """(acronym, phrase) whose phrase is defined ``times`` as often as the runner-up; ``counts`` (acronym, phrase, docs)."""
    w = Window.partitionBy("acronym").orderBy(F.desc("docs"), "phrase")
    out = counts.withColumn("_next", F.lead("docs").over(w)).withColumn("_r", F.row_number().over(w))
    return out.filter((F.col("_r") == 1) & (F.col("_next").isNull() | (F.col("docs") >= times * F.col("_next")))).select("acronym", "phrase")


def merge_risk(pairs: DataFrame) -> DataFrame:
    """(id, risk): why a merge (id, a, b, type_a, type_b, degree_a, degree_b) needs a person: another type, other numbers, or two well-connected ends."""
    numbers = ~T.same_numbers(F.col("a"), F.col("b"))
    busy = F.least("degree_a", "degree_b") >= 20
    risk = F.when(F.col("type_a") != F.col("type_b"), "type").when(numbers, "numbers").when(busy, "connected")
    return pairs.withColumn("risk", risk).filter("risk IS NOT NULL").select("id", "risk")


def no_common_word(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(T.tokens(a), T.tokens(b))


def trigrams(name: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def precedents(decided: DataFrame, name: str, k: int) -> DataFrame:
    """(id, jaccard): the decided cases (id, name) whose names are likest by 3-grams."""
    a, b = trigrams(F.col("name")), trigrams(F.lit(name))
    score = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return decided.select("id", F.round(score, 6).alias("jaccard")).orderBy(F.desc("jaccard"), "id").limit(k)


def stale_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group, changed): members (group, member) that came or went; a group whose summary must be written again has any."""
    o, n = old.select("group", "member").withColumn("_o", F.lit(1)), new.select("group", "member").withColumn("_n", F.lit(1))
    return o.join(n, ["group", "member"], "full").groupBy("group").agg(F.count_if(F.col("_o").isNull() | F.col("_n").isNull()).alias("changed")).filter("changed > 0")


def folded_captures(captures: DataFrame, span_seconds: int) -> DataFrame:
    """(address, first, n): captures (address, at, id) of one address within a span of the one before, folded into the first of the run."""
    w = Window.partitionBy("address").orderBy("at", "id")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > span_seconds, F.lit(True)).cast("int")
    run = captures.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("address", "_run").agg(F.min_by("id", F.struct("at", "id")).alias("first"), F.count("*").alias("n")).drop("_run")


def apart(towns: DataFrame) -> DataFrame:
    """(town, label): towns (town, name, region) by name, with their region where another town has that name."""
    n = F.count("*").over(Window.partitionBy("name"))
    return towns.withColumn("_n", n).select("town", F.when(F.col("_n") > 1, F.concat("name", F.lit(", "), "region")).otherwise(F.col("name")).alias("label"))


def clean_glyphs(text: Column) -> Column:
    """Ligatures, typographic quotes and soft hyphens as plain characters."""
    for glyph, plain in GLYPHS.items():
        text = F.replace(text, F.lit(glyph), F.lit(plain))
    return text


def comment_heading(title: Column) -> Column:
    return F.lower(F.trim(title)).rlike(r"^(\d+ )?(comments?|kommentare?|responses|antworten|leave a (reply|comment))\b")


def tag_date(html: Column) -> Column:
    """A page's date from its tags, the most trusted first: citation, article, then any date tag."""
    tag = lambda name: F.nullif(F.regexp_extract(html, rf'(?i)<meta name="{name}" content="([0-9-]+)"', 1), F.lit(""))
    return F.coalesce(tag("citation_date"), tag("article:published_time"), tag("date"))
