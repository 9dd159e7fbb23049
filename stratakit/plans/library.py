"""Document reads, queues, page trees and labels over tables that are derived from the star schema, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.operators import documents as D
from stratakit.operators import library as L
from stratakit.plans.base import query, table
from stratakit.plans.graphs import NODES_SQL, edges, nodes
from stratakit.plans.retrieval import WINDOWS_SQL

#: Documents as files of a library; every column follows from the document's id.
FILES_SQL = """f AS (SELECT doc_id, text, lang, source, n_chars,
  CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'video/mp4' ELSE 'text/markdown' END AS mime,
  CASE doc_id % 17 WHEN 3 THEN 'note' WHEN 5 THEN 'page' END AS kind, doc_id % 41 AS pages, doc_id % 13 = 4 AS retired,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id * 17), '%Y-%m-%d %H:%M') AS added, 'root/' || source || '/' || (doc_id % 7) || '/' || doc_id AS path,
  CASE WHEN doc_id % 6 = 0 THEN [] WHEN doc_id % 6 < 4 THEN [source] ELSE [source, 'src0'] END AS domains FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    mime = F.element_at(F.array(*map(F.lit, ("application/pdf", "text/html", "image/jpeg", "video/mp4", "text/markdown"))), (i % 5 + 1).cast("int"))
    source = F.col("source")
    return docs.select(
        i, "text", "lang", source, "n_chars", mime.alias("mime"), F.when(i % 17 == 3, "note").when(i % 17 == 5, "page").alias("kind"), (i % 41).alias("pages"), (i % 13 == 4).alias("retired"),
        F.date_format(F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, CAST(doc_id * 17 AS INT))"), "yyyy-MM-dd HH:mm").alias("added"),
        F.concat(F.lit("root/"), source, F.lit("/"), (i % 7).cast("string"), F.lit("/"), i.cast("string")).alias("path"),
        F.when(i % 6 == 0, F.array().cast("array<string>")).when(i % 6 < 4, F.array(source)).otherwise(F.array(source, F.lit("src0"))).alias("domains"),
    )


@query("SELECT doc_id, substr(text, 101, 200) AS part, len(text) AS length, len(text) > 300 AS more FROM documents")
def doc_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.text_window(table(spark, sf_dir, "documents"), 100, 200).withColumn("length", F.col("length").cast("long"))


@query(f"WITH {FILES_SQL} SELECT doc_id, mime FROM f WHERE starts_with(mime, 'text/') AND contains(lower(text), 'tion') AND n_chars > 500 AND NOT retired ORDER BY doc_id LIMIT 60")
def doc_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = [F.col("mime").startswith("text/"), D.title_contains(F.col("text"), "TION"), F.col("n_chars") > 500, ~F.col("retired")]
    return L.batch(files(spark, sf_dir), where, 60).select("doc_id", "mime")


_DOCTYPE_SQL = "CASE WHEN kind IS NOT NULL THEN kind WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime = 'text/html' THEN 'web' WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'image/%' THEN 'image' ELSE 'text' END"


@query(f"WITH {FILES_SQL} SELECT {_DOCTYPE_SQL} AS doctype, count(*) AS n FROM f GROUP BY 1")
def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.facet(files(spark, sf_dir).select(L.doctype(F.col("mime"), F.col("kind")).alias("doctype")), "doctype")


@query(f"WITH {FILES_SQL} SELECT doc_id, path FROM f WHERE starts_with(path, 'root/src1/')")
def doc_under_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal prefix: the slash ends the name."""
    return files(spark, sf_dir).filter(F.col("path").startswith("root/src1/")).select("doc_id", "path")


@query(f"WITH {FILES_SQL} SELECT doc_id FROM f WHERE len(domains) = 0 OR list_has_any(domains, ['src0', 'src2'])")
def doc_in_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two domains, and those of none, which belong to all."""
    return files(spark, sf_dir).filter(D.holds_domain(F.col("domains"), ["src0", "src2"], unset=True)).select("doc_id")


_TREE_SQL = "tree AS (SELECT DISTINCT source AS name, CASE WHEN source = 'src0' THEN NULL ELSE 'src' || (substr(source, 4)::INT // 2) END AS parent FROM documents)"


@query(f"""WITH RECURSIVE {FILES_SQL}, {_TREE_SQL}, up AS (SELECT name, name AS ancestor, parent FROM tree UNION ALL SELECT up.name, tree.name, tree.parent FROM up JOIN tree ON up.parent = tree.name),
e AS (SELECT doc_id, unnest(CASE WHEN len(domains) = 0 THEN [NULL] ELSE domains END) AS name FROM f), own AS (SELECT name, count(*) AS own FROM e GROUP BY name),
ins AS (SELECT ancestor AS name, count(DISTINCT doc_id) AS within FROM e JOIN up USING (name) GROUP BY 1)
SELECT coalesce(own.name, ins.name) AS domain, coalesce(own, 0) AS own, coalesce(within, 0) AS within FROM own FULL JOIN ins ON own.name = ins.name""")
def doc_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are domains: source n lies within source n // 2."""
    docs = files(spark, sf_dir)
    number = F.floor(F.substring("source", 4, 9).cast("int") / 2).cast("string")
    tree = docs.select(F.col("source").alias("name"), F.when(F.col("source") != "src0", F.concat(F.lit("src"), number)).alias("parent")).distinct()
    return L.domain_counts(docs.select("doc_id", "domains"), tree)


@query(f"WITH {NODES_SQL}, d AS (SELECT DISTINCT source_doc, e AS node FROM (SELECT source_doc, src AS e FROM edges UNION ALL SELECT source_doc, dst FROM edges)), c AS (SELECT source_doc, type, count(*) AS n FROM d JOIN nodes ON node = id GROUP BY ALL) SELECT source_doc, type, n, round(n / sum(n) OVER (PARTITION BY source_doc), 6) AS share FROM c")
def doc_fact_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of things each document states facts about."""
    e = edges(spark, sf_dir)
    ends = e.select("source_doc", F.col("src").alias("id")).unionByName(e.select("source_doc", F.col("dst").alias("id"))).distinct()
    return L.share_by(ends.join(nodes(spark, sf_dir).select("id", "type"), "id"), "source_doc", "id", "type").withColumn("share", F.round("share", 6))


@query(f"WITH {FILES_SQL} SELECT doc_id, added FROM f WHERE added >= '2024-01-02' AND added < '2024-01-04'")
def doc_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter("added >= '2024-01-02' AND added < '2024-01-04'").select("doc_id", "added")


@query(f"SELECT doc_id, heading, place FROM (SELECT doc_id, heading, row_number() OVER (PARTITION BY doc_id ORDER BY min(seq), heading) AS place FROM (SELECT doc_id, seq, substr(text, 1, 2) AS heading FROM {WINDOWS_SQL}) GROUP BY doc_id, heading) WHERE place <= 20")
def doc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two characters of a passage stand for its heading."""
    passages = D.chunks(table(spark, sf_dir, "documents")).select("doc_id", "seq", F.substring("text", 1, 2).alias("heading"))
    return L.outline(passages).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH n AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM {WINDOWS_SQL} WHERE regexp_matches(text, '[=+<>@0-9]')),
here AS (SELECT doc_id, p FROM n WHERE seq = 4) SELECT n.doc_id, n.seq FROM n JOIN here USING (doc_id) WHERE n.p BETWEEN here.p - 2 AND here.p + 3""")
def doc_equations_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with a formula around that of place 4: two before, three after."""
    held = D.chunks(table(spark, sf_dir, "documents")).filter(F.col("text").rlike("[=+<>@0-9]")).select("doc_id", "seq")
    return D.neighbours(held, "doc_id", "seq", F.col("seq") == 4, L.EQUATIONS_BEFORE, L.EQUATIONS_AFTER).select("doc_id", F.col("seq").cast("long").alias("seq"))


@query(f"SELECT doc_id, min(seq) AS seq FROM {WINDOWS_SQL} WHERE regexp_matches(text, '[0-9]{{2}}') GROUP BY doc_id")
def doc_formula_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first passage of a document that prints a number of two digits."""
    held = D.chunks(table(spark, sf_dir, "documents")).filter(F.col("text").rlike("[0-9]{2}"))
    return held.groupBy("doc_id").agg(F.min("seq").cast("long").alias("seq"))


@query("SELECT doc_id, list_transform(list_sort(list_filter([{'p': -((doc_id * 7 % 100) / 100.0::DOUBLE), 'name': 'prose'}, {'p': -((doc_id * 13 % 100) / 100.0::DOUBLE), 'name': 'list'}, {'p': -((doc_id * 29 % 100) / 100.0::DOUBLE), 'name': 'code'}], lambda x: -x.p >= 0.5)), lambda x: x.name) AS labels FROM documents")
def doc_sure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(*[F.struct(((F.col("doc_id") * k % 100) / 100.0).alias("p"), F.lit(name).alias("name")) for name, k in (("prose", 7), ("list", 13), ("code", 29))])
    return table(spark, sf_dir, "documents").select("doc_id", L.sure_labels(given).alias("labels"))


@query(f"WITH {FILES_SQL} SELECT regexp_extract(path, '^([^/]+/[^/]+)/', 1) AS grp, count(*) FILTER (doc_id % 3 = 0) AS open, count(*) FILTER (doc_id % 3 = 1) AS private, count(*) FILTER (doc_id % 3 = 2) AS unseen, count(*) AS n FROM f WHERE mime IN ('image/jpeg', 'video/mp4') GROUP BY 1")
def doc_media_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).filter("mime IN ('image/jpeg', 'video/mp4')")
    rows = rows.withColumn("state", F.element_at(F.array(F.lit("open"), F.lit("private"), F.lit("unseen")), (F.col("doc_id") % 3 + 1).cast("int")))
    return L.media_groups(rows, F.substring_index("path", "/", 2), ["open", "private", "unseen"])


@query(f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN added END AS taken FROM f WHERE starts_with(path, 'root/src0/') AND mime = 'application/pdf' ORDER BY taken NULLS LAST, doc_id LIMIT 40 OFFSET 2")
def doc_media_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).filter("mime = 'application/pdf'").filter(F.col("path").startswith("root/src0/")).select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("added")).alias("taken"))
    return D.page(rows, [F.asc_nulls_last("taken"), F.asc("doc_id")], L.MEDIA_PAGE, 2)


@query(f"""WITH {NODES_SQL}, v AS (SELECT source_doc AS doc_id, CASE rel WHEN 'buys_in' THEN 1.0 WHEN 'located_in' THEN 3.0 ELSE 2.0 END AS w FROM edges) SELECT doc_id, sum(w)::DOUBLE AS score FROM v WHERE doc_id % 10 <> 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 30""")
def doc_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what speaks for them, but those that are promoted already."""
    e = edges(spark, sf_dir)
    evidence = e.groupBy(F.col("source_doc").alias("doc_id"), F.col("rel").alias("kind")).agg(F.count("*").alias("n"))
    passed = e.select(F.col("source_doc").alias("doc_id")).filter("doc_id % 10 = 0")
    return L.weighted_evidence(evidence, {"buys_in": 1.0, "located_in": 3.0, "part_of": 2.0}, passed, 30)


@query(f"WITH {FILES_SQL} SELECT doc_id, pages, n_chars AS bytes, n_chars // pages AS per_page FROM f WHERE mime = 'application/pdf' AND NOT retired AND pages >= 5 AND n_chars / pages < 100")
def doc_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).filter("mime = 'application/pdf' AND NOT retired").select("doc_id", "pages", F.col("n_chars").alias("bytes"))
    return L.thin(rows)


@query("""WITH q AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'numbers' END], lambda x: x IS NOT NULL)) AS finding FROM documents) SELECT finding, count(*) AS n, min(doc_id) AS first FROM q GROUP BY finding""")
def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.col("n_chars") < 300, "short"), F.when(F.col("text").contains("@"), "mail"), F.when(F.col("text").rlike("[0-9]{4}"), "numbers")))
    return L.findings(table(spark, sf_dir, "documents").select("doc_id", found.alias("findings")))


@query(f"WITH {FILES_SQL} SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN '2019' END, CASE WHEN doc_id % 3 = 0 THEN '2020-05' END, CASE WHEN doc_id % 2 = 0 THEN substr(added, 1, 10) END) AS published FROM f")
def doc_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    said = [F.when(i % 5 == 0, "2019"), F.when(i % 3 == 0, "2020-05"), F.when(i % 2 == 0, F.substring("added", 1, 10))]
    return files(spark, sf_dir).select("doc_id", D.published(said).alias("published"))


@query(f"WITH {FILES_SQL} SELECT mime, count(*) AS n, round(count(*) FILTER (n_chars > 0) / count(*), 6) AS with_text, round(count(*) FILTER (kind IS NOT NULL) / count(*), 6) AS with_kind FROM f WHERE NOT retired GROUP BY mime")
def doc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type's live documents the shares that have text and a kind."""
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    rows = files(spark, sf_dir).filter(L.live(F.when(F.col("retired"), F.lit(1))))
    return rows.groupBy("mime").agg(F.count("*").alias("n"), share(F.col("n_chars") > 0).alias("with_text"), share(F.col("kind").isNotNull()).alias("with_kind"))


@query("SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS place, event_id AS version FROM events QUALIFY place BETWEEN 1 AND 10")
def doc_earlier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events stand for the texts that a document had."""
    held = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("ts").alias("at"), F.col("event_id").alias("version"))).alias("history"))
    return L.earlier_texts(held).select("doc_id", F.col("place").cast("long").alias("place"), "version")


@query("SELECT split_part(url, '?', 1) AS address, count(*) AS captures, max(page_id) AS newest FROM pages GROUP BY 1")
def doc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.substring_index("url", "?", 1).alias("address")).agg(F.count("*").alias("captures"), F.max("page_id").alias("newest"))


@query(f"WITH {FILES_SQL} SELECT doc_id, doc_id % 4 = 0 AS has_doi FROM f WHERE mime = 'application/pdf' ORDER BY has_doi DESC, doc_id LIMIT 50")
def doc_citation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).filter("mime = 'application/pdf'").select("doc_id", (F.col("doc_id") % 4 == 0).alias("has_doi"))
    return D.page(rows, [F.desc("has_doi"), F.asc("doc_id")], 50)


@query("SELECT doc_id FROM (SELECT doc_id, '{\"source\": {\"importer\": \"' || source || '\", \"key\": \"k' || (doc_id % 9) || '\"}}' AS meta FROM documents) WHERE meta->>'$.source.importer' = 'src2' AND meta->>'$.source.key' = 'k4'")
def doc_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.concat(F.lit('{"source": {"importer": "'), "source", F.lit('", "key": "k'), (F.col("doc_id") % 9).cast("string"), F.lit('"}}'))
    at = lambda path: F.get_json_object("meta", path)
    return table(spark, sf_dir, "documents").select("doc_id", meta.alias("meta")).filter((at("$.source.importer") == "src2") & (at("$.source.key") == "k4")).select("doc_id")


_ASKED_SQL = "asked AS (SELECT event_id, ts, user_id AS doc_id, event_type AS extractor FROM events)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to read a document."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("doc_id"), F.col("event_type").alias("extractor"))


@query(f"WITH {_ASKED_SQL} SELECT extractor, count(*) AS waiting, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest FROM asked WHERE event_id % 3 = 0 GROUP BY extractor")
def queue_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).filter("event_id % 3 = 0")
    return rows.groupBy("extractor").agg(F.count("*").alias("waiting"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("oldest"))


@query(f"WITH {_ASKED_SQL} SELECT DISTINCT doc_id, extractor FROM asked a WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM asked w WHERE w.event_id % 7 = 1 AND w.doc_id = a.doc_id AND w.extractor = a.extractor)")
def queue_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir)
    return L.request(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 7 = 1"), ["doc_id", "extractor"])


@query(f"WITH {FILES_SQL}, a AS (SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'signup'), s AS (SELECT f.doc_id, CASE WHEN f.doc_id % 4 <> 0 THEN f.doc_id % 7 END AS stamp, a.doc_id IS NOT NULL AS first FROM f LEFT JOIN a USING (doc_id)) SELECT doc_id, stamp, first FROM s WHERE first OR stamp IS NULL OR stamp < 5")
def queue_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read under an older version, or asked for."""
    rows = files(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 7).alias("stamp"))
    return L.due(rows, _asked(spark, sf_dir).filter("extractor = 'signup'"), 5)


@query("SELECT l.doc_id, bool_or(quality = 1) AS done FROM labels l GROUP BY l.doc_id HAVING list_contains(list(toxic), 0)")
def queue_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1)).alias("done"), F.collect_list("toxic").alias("_t"))
    return held.filter(F.array_contains("_t", 0)).select("doc_id", "done")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20")
def queue_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return D.page(rows, [F.desc("ts"), F.asc("event_id")], 20).select("event_id", "user_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) ORDER BY doc_id DESC LIMIT 50")
def queue_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id"), "doc_id", "left_anti")
    return D.page(rows, [F.desc("doc_id")], 50)


@query("SELECT c_nationkey % 2 AS level, c_nationkey AS id, count(*) AS size FROM customer GROUP BY ALL HAVING c_nationkey % 3 = 0 OR max(c_custkey) % 5 > c_nationkey % 5 ORDER BY level, size DESC, id LIMIT 10")
def queue_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as communities: a third has no summary, others changed after theirs."""
    key = F.col("c_nationkey")
    groups = table(spark, sf_dir, "customer").groupBy(key.alias("id")).agg(F.count("*").alias("size"), (F.max("c_custkey") % 5).alias("changed"))
    groups = groups.withColumn("level", F.col("id") % 2).withColumn("summarised", F.when(F.col("id") % 3 != 0, F.col("id") % 5))
    return L.stale_summaries(groups, 10).select("level", "id", "size")


@query("SELECT vec_id FROM embeddings WHERE NOT list_contains(list_transform(range(vec_id % 4), lambda i: 'model' || i), 'model2')")
def queue_unread_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that one model has not read; a figure's readings are an array."""
    models = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int")), lambda i: F.concat(F.lit("model"), i.cast("string")))
    readings = F.slice(models, F.lit(1), (F.col("vec_id") % 4).cast("int"))
    return table(spark, sf_dir, "embeddings").filter(~F.exists(readings, lambda m: m == "model2")).select("vec_id")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS done FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL")
def queue_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-20'")
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("done"))


@query("SELECT max(doc_id) AS newest, count(*) AS n FROM documents")
def queue_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("newest"), F.count("*").alias("n"))


@query("SELECT user_id AS page, event_id AS revision, event_type AS said FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def page_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current revision of each page; a user's events are a page's revisions."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "ts", F.col("event_id").alias("revision"), F.col("event_type").alias("said"))
    return L.latest(rows, ["page"], [F.col("ts"), F.col("revision")]).drop("ts")


@query("SELECT user_id AS page, max(event_id) AS revision, count(*) AS revisions FROM events GROUP BY user_id ORDER BY max(ts) DESC, page LIMIT 30")
def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(F.max("event_id").alias("revision"), F.count("*").alias("revisions"), F.max("ts").alias("_at"))
    return D.page(rows, [F.desc("_at"), F.asc("page")], 30).drop("_at")


@query("SELECT user_id AS page, event_id AS revision, event_type AS said FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 3")
def page_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third revision of each page."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("_r", F.row_number().over(w)).filter("_r = 3")
    return rows.select(F.col("user_id").alias("page"), F.col("event_id").alias("revision"), F.col("event_type").alias("said"))


_PAGES_SQL = "tree AS (SELECT p_partkey AS name, CASE WHEN p_partkey > 3 THEN p_partkey // 3 END AS parent FROM part WHERE p_partkey > 0)"


def _page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey > 0").select(key.alias("name"), F.when(key > 3, F.floor(key / 3)).alias("parent"))


@query(f"WITH RECURSIVE {_PAGES_SQL}, up AS (SELECT name, name AS ancestor, parent FROM tree UNION ALL SELECT up.name, tree.name, tree.parent FROM up JOIN tree ON up.parent = tree.name) SELECT name FROM up WHERE ancestor = 2")
def page_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below page 2, itself included; page p lies below page p // 3."""
    return L.within(_page_tree(spark, sf_dir)).filter("ancestor = 2").select("name")


@query(f"WITH RECURSIVE {_PAGES_SQL}, up AS (SELECT name, name AS ancestor, parent FROM tree UNION ALL SELECT up.name, tree.name, tree.parent FROM up JOIN tree ON up.parent = tree.name) SELECT DISTINCT l_orderkey AS doc FROM up JOIN lineitem ON l_partkey = name WHERE ancestor = 3 AND l_suppkey % 5 <> 0")
def page_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pages below page 3 name, without personal ones."""
    pages = L.within(_page_tree(spark, sf_dir)).filter("ancestor = 3").select("name")
    held = table(spark, sf_dir, "lineitem").filter("l_suppkey % 5 <> 0").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("doc"))
    return held.join(pages, "name", "left_semi").select("doc").distinct()


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '<h1[ >]')")
def page_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold a piece of one kind."""
    return table(spark, sf_dir, "pages").filter(F.col("html").rlike("<h1[ >]")).select("page_id")


_LABELS_SQL = "lab AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS entity, CASE l_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang, CASE WHEN l_linenumber < 3 THEN 'pref' ELSE 'alt' END AS kind, 'n' || l_partkey AS label FROM lineitem WHERE l_suppkey % 4 <> l_partkey % 3 OR l_suppkey % 2 = 0)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as labels of suppliers."""
    lang = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (F.col("l_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").filter("l_suppkey % 4 <> l_partkey % 3 OR l_suppkey % 2 = 0")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("entity"), lang.alias("lang"), F.when(F.col("l_linenumber") < 3, "pref").otherwise("alt").alias("kind"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("label"))


@query(f"WITH {_LABELS_SQL} SELECT id, CASE WHEN kind = 'pref' AND row_number() OVER (PARTITION BY entity, lang, kind ORDER BY id DESC) > 1 THEN 'alt' ELSE kind END AS kind FROM lab")
def label_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.preferred(_labels(spark, sf_dir)).select("id", "kind")


@query(f"WITH {_LABELS_SQL} SELECT entity, label AS shown FROM lab QUALIFY row_number() OVER (PARTITION BY entity ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, kind <> 'pref', id) = 1")
def label_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shown_names(_labels(spark, sf_dir), ["de", "en"])


@query(f"WITH {_LABELS_SQL} SELECT s_suppkey AS id, count(*) AS uses FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey NOT IN (SELECT entity FROM lab WHERE lang = 'de' AND kind = 'pref' AND id % 8 = 1) GROUP BY s_suppkey")
def label_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("uses"))
    return L.unlabelled(uses, _labels(spark, sf_dir).filter("kind = 'pref' AND id % 8 = 1"), "de").select("id", "uses")


@query("WITH e AS (SELECT DISTINCT lower(p_name) AS name, p_brand AS type FROM part), p AS (SELECT a.name, a.type AS x, b.type AS y FROM e a JOIN e b USING (name) WHERE a.type < b.type AND NOT (a.type = 'Brand#11' AND b.type = 'Brand#12')), t AS (SELECT name, unnest([x, y]) AS type FROM p) SELECT name, list_sort(list_distinct(list(type))) AS types FROM t GROUP BY name")
def label_split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that things of unrelated types share."""
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    return L.shared_names(parts, spark.createDataFrame([("Brand#11", "Brand#12")], "a string, b string"))


@query("SELECT c_custkey AS entity, min(o_orderstatus) AS lang FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def label_sole_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a customer's orders stand for the languages a thing is named in."""
    return L.sole_language(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("lang")))


_FACES_SQL = "ans AS (SELECT event_id, user_id AS face, event_type AS person, ts AS given, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended, value FROM events)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as answers about one face: each replaces the one before, none is overwritten."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("face"), F.col("event_type").alias("person"), F.lead("ts").over(w).alias("ended"), "event_id", "value")


@query(f"WITH {_FACES_SQL} SELECT face, person, event_id FROM ans WHERE ended IS NULL")
def face_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).filter("ended IS NULL").select("face", "person", "event_id")


@query(f"WITH {_FACES_SQL} SELECT face, person FROM ans WHERE ended IS NULL ORDER BY value DESC, face LIMIT 25 OFFSET 5")
def faces_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest answers first."""
    return D.page(_answers(spark, sf_dir).filter("ended IS NULL"), [F.desc("value"), F.asc("face")], 25, 5).select("face", "person")


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, regexp_extract(u, '(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})', 1) AS arxiv FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'https://arxiv.org/abs/' || lpad((1000 + page_id)::VARCHAR, 4, '0') || '.0' || lpad((page_id % 10000)::VARCHAR, 4, '0') || 'v2' ELSE url END AS u FROM pages)""")
def page_ids_in_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("https://arxiv.org/abs/"), F.lpad((F.col("page_id") + 1000).cast("string"), 4, "0"), F.lit(".0"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.lit("v2"))
    at = F.when(F.col("page_id") % 3 == 0, made).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)).alias("host"), F.coalesce(T.arxiv_of_url(at), F.lit("")).alias("arxiv"))
