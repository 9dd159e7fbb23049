"""Reads, repairs and resolution over edges, entities and references, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.sources.scratch import settled

# A sure citation's score and lead, facts named of a document, hits that a region is told from and its share.
SURE, LEAD = 0.82, 0.06
DOCUMENT_FACTS = 8
REGION_HITS, REGION_SHARE = 5, 0.5
#: Words an acronym's phrase may open with that are no part of it.
LEAD_WORDS = ("the", "a", "an", "called", "so-called", "termed", "of", "for", "or", "and")


def walk(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(node, depth): nodes within ``hops`` of ``starts`` (node), each at its least depth."""
    both = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).unionByName(edges.select(F.col("dst").alias("_a"), F.col("src").alias("_b"))).distinct()
    seen = front = starts.select("node", F.lit(0).alias("depth"))
    for depth in range(1, hops + 1):
        near = front.join(both, F.col("node") == F.col("_a")).select(F.col("_b").alias("node")).distinct()
        front = settled(near.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(front)
    return seen


def chosen(entities: DataFrame, kind: str) -> DataFrame:
    """(name, id): of entities (id, name, type, degree) of one name that of a type, else the most connected, the oldest of equals."""
    best = F.min_by("id", F.struct((F.col("type") != kind).alias("t"), (-F.col("degree")).alias("d"), "id"))
    return entities.groupBy(F.lower("name").alias("name")).agg(best.alias("id"))


def disputed(edges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Edges with the number of live conflicts (a, b: edge ids) each is a side of."""
    sides = conflicts.select(F.col("a").alias("id")).unionByName(conflicts.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("_n"))
    return edges.join(sides, "id", "left").withColumn("conflicts", F.coalesce("_n", F.lit(0))).drop("_n")


def dated(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges with ``stated``: the date of their document where the fact itself has none."""
    known = edges.join(documents.select(F.col("doc_id").alias("source_doc"), "published"), "source_doc", "left")
    return known.withColumn("stated", F.when(F.col("world_from").isNull() & F.col("world_to").isNull(), F.col("published"))).drop("published")


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, edges): how many edges join two of the ``nodes`` (node)."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    held = edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").filter("src <> dst")
    return held.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("edges"))


def capped(rows: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows of each group, in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")


def sharing(members: DataFrame, wanted: DataFrame, at_least: int) -> DataFrame:
    """(doc, shared): documents (doc, entity) that hold ``at_least`` of the wanted entities."""
    return members.select("doc", "entity").distinct().join(wanted.select("entity").distinct(), "entity", "left_semi").groupBy("doc").agg(F.count("*").alias("shared")).filter(F.col("shared") >= at_least)


def found(entities: DataFrame, labels: DataFrame, words: str, degree: DataFrame, limit: int) -> DataFrame:
    """(id, degree): entities whose name, or a label (id, label), holds ``words`` in any case; the most connected first."""
    low = lambda c: F.contains(F.lower(c), F.lower(F.lit(words)))
    ids = entities.filter(low(F.col("name"))).select("id").unionByName(labels.filter(low(F.col("label"))).select("id")).distinct()
    out = ids.join(degree.select(F.col("node").alias("id"), "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.orderBy(F.desc("degree"), "id").limit(limit)


def global_id(source: Column, rel: Column, src: Column, dst: Column) -> Column:
    """An edge's id by what it claims: its document's hash, relation and ends."""
    return F.concat(F.lit("c:"), F.sha2(F.concat_ws("\x1f", F.coalesce(source, F.lit("")), rel, src, dst), 256))


def ended(edges: DataFrame, endings: DataFrame) -> DataFrame:
    """Edges with ``valid_to`` from endings (id, at, run, undone): the last ending that no one undid."""
    last = endings.filter("NOT undone").groupBy("id").agg(F.max("at").alias("_at"))
    return edges.join(last, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "_at")).drop("_at")


def set_apart(added: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """(added, corrected, ended, replaced): counts of a pass whose additions and endings of one key are corrections, not news."""
    a, g = added.select(*keys).distinct().withColumn("_a", F.lit(1)), gone.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_g").isNotNull()
    return a.join(g, keys, "full").agg(F.count_if(F.col("_g").isNull()).alias("added"), F.count_if(F.col("_a").isNull()).alias("ended"), F.count_if(both).alias("corrected"))


def work_order(versions: DataFrame) -> DataFrame:
    """(doc_id, later): of documents (work, doc_id, published, added) those with a later version, and the latest of the work; undated ones come first."""
    w = Window.partitionBy("work").orderBy(F.asc_nulls_first("published"), "added", "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return versions.withColumn("later", F.last("doc_id").over(w)).filter("later <> doc_id").select("doc_id", "later")


def chain_by_document(first: DataFrame, second: DataFrame, private: DataFrame) -> DataFrame:
    """(src, dst, doc): a -> m -> c from open premises together (doc null), and from each private document with the open ones by itself.

    ``first`` and ``second`` (src, dst, doc); a pair that open premises give is
    not said again of a private document.
    """
    own = lambda frame, name: frame.join(private.select("doc").distinct().withColumn("_p", F.lit(True)), "doc", "left").select("src", "dst", F.when(F.col("_p"), F.col("doc")).alias(name))
    a, b = own(first, "_x").withColumnRenamed("dst", "_m"), own(second, "_y").withColumnRenamed("src", "_n")
    joined = a.join(b, F.col("_m") == F.col("_n")).filter(F.col("_x").isNull() | F.col("_y").isNull() | (F.col("_x") == F.col("_y"))).filter("src <> dst")
    derived = joined.select("src", "dst", F.coalesce("_x", "_y").alias("doc")).distinct()
    open_ones = derived.filter("doc IS NULL")
    return open_ones.unionByName(derived.filter("doc IS NOT NULL").join(open_ones.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "doc"))


def backwards(edges: DataFrame) -> DataFrame:
    """Edges (id, src_name, dst_name) of a whole and its part that stand the wrong way round by their names: the whole's name holds the part's."""
    norm = lambda c: F.concat(F.lit(" "), T.normal_title(F.col(c)), F.lit(" "))
    return edges.filter(F.contains(norm("dst_name"), norm("src_name")) & (T.normal_title(F.col("src_name")) != T.normal_title(F.col("dst_name")))).select("id")


def glued(key: Column) -> Column:
    """A name's key with a letter and the number after it written together."""
    return F.regexp_replace(key, r"(?<=\p{L}) (?=\d)", "")


def into_survivor(entities: DataFrame, by: list[str], keep: Column | None = None) -> DataFrame:
    """(id, into): entities (id, name, degree) of a group into the one that survives; ``keep`` prefers some."""
    capitals = F.length(F.regexp_replace("name", r"[^\p{Lu}]", ""))
    order = [*([keep.desc()] if keep is not None else []), F.desc("degree"), F.desc(capitals), F.length("name"), F.asc("id")]
    return entities.withColumn("into", F.first("id").over(Window.partitionBy(*by).orderBy(*order))).filter("id <> into").select("id", "into")


def subtype_folds(entities: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, into): an entity (id, key, type) into the one of the same key whose type is below its own; ``closure`` (name, ancestor)."""
    two = lambda rows: rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("key", "type").orderBy("id"))).filter("_r <= 2").select("key", "type", "id").distinct()
    below = closure.filter("name <> ancestor").select(F.col("name").alias("type"), F.col("ancestor").alias("_up")).distinct()
    # Of a name and type the two least are enough: the least, and another for a thing that is the least itself.
    named = two(entities.select("key", "type", "id").filter("key IS NOT NULL AND id IS NOT NULL"))
    named = two(named.join(below, "type").select("key", F.col("_up").alias("type"), "id"))
    least = named.groupBy("key", "type").agg(F.min("id").alias("_a"), F.max("id").alias("_b"))
    into = F.when(F.col("id") != F.col("_a"), F.col("_a")).when(F.col("id") != F.col("_b"), F.col("_b"))
    found = entities.join(settled(least, "least-below"), ["key", "type"]).select("id", into.alias("into")).filter("into IS NOT NULL")
    return found.groupBy("id").agg(F.min("into").alias("into"))


def tiers(plans: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, into, tier): merges of several tiers; an entity that an earlier tier takes, on either side, is not touched again."""
    out, taken = None, None
    for name, plan in plans:
        plan = plan.select("id", "into")
        if taken is not None:
            plan = plan.join(taken, "id", "left_anti").join(taken.withColumnRenamed("id", "into"), "into", "left_anti").select("id", "into")
        plan = settled(plan.withColumn("tier", F.lit(name)), "merge-tier")
        out = plan if out is None else out.unionByName(plan)
        now = plan.select("id").unionByName(plan.select(F.col("into").alias("id"))).distinct()
        taken = now if taken is None else taken.unionByName(now).distinct()
    return out


def same_facts(edges: DataFrame) -> DataFrame:
    """(id, n, last): facts (src, rel, dst) live more than once from one document and producer; the oldest edge stays."""
    held = edges.filter(F.col("valid_to").isNull() & F.col("source_doc").isNotNull())
    return held.groupBy("src", "rel", "dst", "source_doc", "producer").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max("id").alias("last")).filter("n > 1").select("id", "n", "last")


def spacing_twins(entities: DataFrame, least: int = 6) -> DataFrame:
    """(type, joined, names, first): names of a type that differ in spacing alone and hold the same numbers."""
    key = T.normal_name(F.col("name"))
    rows = entities.select("id", "type", key.alias("_k"), F.replace(key, F.lit(" "), F.lit("")).alias("joined")).filter(F.length("joined") >= least)
    numbers = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("_k", F.lit(r"(\d+)"), F.lit(1)))), " ")
    groups = rows.groupBy("type", "joined").agg(F.count_distinct("_k").alias("names"), F.count_distinct(numbers).alias("_n"), F.min("id").alias("first"))
    return groups.filter("names > 1 AND _n = 1").drop("_n")


def recaptured(captures: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(id, into): captures (id, address, rank) of one address into the one of the highest rank, if their sets of passages (id, members) are alike."""
    best = F.max_by("id", F.struct("rank", (-F.col("id")).alias("i"))).over(Window.partitionBy("address"))
    rows = captures.select("id", best.alias("into")).filter("id <> into")
    held = rows.join(sets.select("id", F.col("members").alias("_a")), "id").join(sets.select(F.col("id").alias("into"), F.col("members").alias("_b")), "into")
    union = F.size(F.array_union("_a", "_b"))
    return held.filter(F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("_a", "_b")) / union) >= least).select("id", "into")


def cited(entry: Column) -> Column:
    """A reference as (surname, year, title, doi): "Surname, I. (year). Title. doi:…"."""
    pick = lambda pattern: F.nullif(F.regexp_extract(entry, pattern, 1), F.lit(""))
    year = pick(r"\((\d{4})[a-z]?\)")
    return F.struct(pick(r"^(?:\[\d+\]\s*)?(\p{Lu}[\p{L}'-]+),").alias("surname"), year.cast("int").alias("year"), F.trim(pick(r"\(\d{4}[a-z]?\)\.\s*([^.]+)\.")).alias("title"), F.lower(pick(r"(?i)doi:\s*(10\.\d{4,9}/\S+)")).alias("doi"))


def entries(text: Column) -> Column:
    """Entries of a numbered reference list, one a mark like [12]."""
    return F.filter(F.transform(F.split(text, r"(?=\[\d+\])"), lambda e: F.trim(F.regexp_replace(e, r"\s+", " "))), lambda e: e.rlike(r"^\[\d+\]"))


def decided(scored: DataFrame, sure: float = SURE, lead: float = LEAD) -> DataFrame:
    """(ref, doc_id, verdict): of scored candidates (ref, doc_id, score) the sure one, or all that are too close to tell."""
    best = F.max("score").over(Window.partitionBy("ref"))
    near = scored.withColumn("_best", best).filter((F.col("score") >= sure) & (F.col("_best") - F.col("score") < lead))
    n = F.count("*").over(Window.partitionBy("ref"))
    return near.withColumn("verdict", F.when(n > 1, "ambiguous").otherwise("sure")).select("ref", "doc_id", "verdict")


def _resolved(refs: DataFrame, by_doi: DataFrame, by_title: DataFrame) -> DataFrame:
    """``refs`` (doi, title) with their title's ``key``, the document ``_d`` that has their DOI, and ``_t``, the only one that has the key."""
    first = refs.join(by_doi.select("doi", F.col("doc_id").alias("_d")), "doi", "left")
    sole = by_title.groupBy("key").agg(F.min("doc_id").alias("_t"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return first.withColumn("key", T.title_key(F.col("title"))).join(sole, "key", "left")


def linked(refs: DataFrame, by_doi: DataFrame, by_title: DataFrame) -> DataFrame:
    """(ref, doc_id, how): references (ref, doi, title) to documents by DOI, else by their title's key if one document alone has it."""
    both = _resolved(refs, by_doi, by_title)
    out = both.select("ref", F.coalesce("_d", "_t").alias("doc_id"), F.when(F.col("_d").isNotNull(), "doi").when(F.col("_t").isNotNull(), "title").alias("how"))
    return out.filter("doc_id IS NOT NULL")


def missing_works(refs: DataFrame, by_doi: DataFrame, by_title: DataFrame, limit: int) -> DataFrame:
    """(work, docs): works (doc, ref, doi, title) that no document is linked to (``linked``), by DOI or else title key, the most cited first.

    References are read once: a window tells those that are linked in any of their rows.
    """
    rows = _resolved(refs, by_doi, by_title).select("ref", "doc", F.coalesce("doi", "key").alias("work"), F.coalesce("_d", "_t").isNotNull().alias("_held"))
    rows = rows.withColumn("_held", F.max("_held").over(Window.partitionBy("ref"))).filter("NOT _held AND work IS NOT NULL")
    return rows.groupBy("work").agg(F.count_distinct("doc").alias("docs")).orderBy(F.desc("docs"), "work").limit(limit)


def acronyms(text: Column) -> Column:
    """(acronym, phrase) pairs that a text defines as "some long phrase (SLP)", in lower case: the phrase is the first of its tails whose initials are the acronym."""
    pattern = r"((?:[A-Za-z][A-Za-z\-]*[a-z] ){1,6}[A-Za-z][A-Za-z\-]*[a-z] \([A-Z][A-Za-z0-9]{1,7}\))"

    def read(found: Column) -> Column:
        letters = F.regexp_replace(F.lower(F.regexp_extract(found, r"\(([^)]*)\)$", 1)), "[^a-z]", "")
        words = F.filter(F.split(F.lower(F.regexp_extract(found, r"^(.*) \(", 1)), r"[ \-]+"), lambda w: w != "")
        n = F.size(words)
        initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
        size = F.length(letters)
        tail = F.slice(words, F.greatest(n - size + 1, F.lit(1)), F.greatest(size, F.lit(1)))
        lead = F.array(*map(F.lit, LEAD_WORDS))
        first = F.coalesce(F.array_min(F.transform(F.filter(F.transform(tail, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: ~F.array_contains(lead, x["w"])), lambda x: x["i"])), size)
        kept = F.slice(tail, first + 1, F.greatest(F.size(tail) - first, F.lit(0)))
        fits = (size >= 2) & (size <= 8) & (F.substring(initials, -9, 9).endswith(letters)) & (n >= size)
        fits = fits & ((F.size(kept) >= 2) | ((F.size(kept) == 1) & (F.length(F.get(kept, F.lit(0))) > size)))
        return F.when(fits, F.struct(letters.alias("acronym"), F.array_join(kept, " ").alias("phrase")))

    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), read)))


def stale(own: DataFrame, replaced: DataFrame, later: DataFrame) -> DataFrame:
    """(doc_id, state, by): documents no longer current, by their own status, a later version of their work, or an edge that replaces them, in this order."""
    rows = own.select("doc_id", "state", F.lit("status").alias("by"), F.lit(0).alias("_o"))
    rows = rows.unionByName(later.select("doc_id", F.lit("superseded").alias("state"), F.lit("versions").alias("by"), F.lit(1).alias("_o")))
    rows = rows.unionByName(replaced.select("doc_id", "state", F.lit("graph").alias("by"), F.lit(2).alias("_o")))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("state", "by"), F.struct("_o", "state")).alias("s")).select("doc_id", "s.*")


def region_of(hits: DataFrame, placed: DataFrame, depth: int = REGION_HITS, share: float = REGION_SHARE) -> DataFrame:
    """(query, region, share): the region that at least ``share`` of a query's first placed hits lie in, if there is one."""
    votes = hits.filter(F.col("place") <= depth).join(placed, "doc_id").groupBy("query", "region").agg(F.count("*").alias("_n"))
    out = votes.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy("query"))).filter(F.col("share") >= share)
    return out.groupBy("query").agg(F.min_by(F.struct("region", "share"), F.struct((-F.col("share")).alias("s"), "region")).alias("b")).select("query", "b.*")


def settle_foreign(foreign: DataFrame, by_gid: DataFrame, aliases: DataFrame, labels: DataFrame) -> DataFrame:
    """(gid, id, how): entities of a foreign file to own ones by global id, by an alias given before, by a label of one thing alone; else new (null)."""
    sole = labels.groupBy(F.lower("label").alias("_l"), "type").agg(F.min("id").alias("_c"), F.count_distinct("id").alias("_n")).filter("_n = 1").drop("_n")
    out = foreign.join(by_gid.select("gid", F.col("id").alias("_a")), "gid", "left").join(aliases.select("gid", F.col("id").alias("_b")), "gid", "left")
    out = out.withColumn("_l", F.lower("name")).join(sole, ["_l", "type"], "left")
    how = F.when(F.col("_a").isNotNull(), "gid").when(F.col("_b").isNotNull(), "alias").when(F.col("_c").isNotNull(), "label").otherwise("new")
    return out.select("gid", F.coalesce("_a", "_b", "_c").alias("id"), how.alias("how"))


def kept_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, text, id): passages of a text written anew; one whose text stood there before keeps its id, equal ones in their order."""
    w = Window.partitionBy("doc_id", "text")
    o = old.withColumn("_k", F.row_number().over(w.orderBy("id"))).select("doc_id", "text", "_k", "id")
    n = new.withColumn("_k", F.row_number().over(w.orderBy("seq"))).select("doc_id", "text", "_k", "seq")
    return n.join(o, ["doc_id", "text", "_k"], "left").select("doc_id", "seq", "id")


def sync_plan(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(key, action): what a folder's files (key, hash) need against what is held: add, refresh, unchanged, moved (its hash is held under a key that is gone) or gone."""
    m, f = manifest.select("key", F.col("hash").alias("_h")), files.select("key", F.col("hash").alias("_f"))
    both = m.join(f, "key", "full")
    gone = both.filter("_f IS NULL").select(F.col("_h").alias("_f")).distinct().withColumn("_was", F.lit(True))
    out = both.join(gone, "_f", "left")
    action = F.when(F.col("_f").isNull(), "gone").when(F.col("_h").isNull(), F.when(F.col("_was"), "moved").otherwise("add")).when(F.col("_h") == F.col("_f"), "unchanged").otherwise("refresh")
    return out.select("key", action.alias("action"))


def fit_or_measure(rows: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Rows with ``part``: fit or measure, by the key's MD5."""
    at = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long")
    return rows.withColumn("part", F.when(at < int(share * (1 << 24)), "fit").otherwise("measure"))
