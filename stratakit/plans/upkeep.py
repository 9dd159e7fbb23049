"""Upkeep of a library over tables that are derived from the star schema, each query with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.operators import upkeep as U
from stratakit.plans.base import query, table
from stratakit.plans.graphs import NODES_SQL, edges, nodes

_W, _AT = f"WITH {NODES_SQL}", "2024-07-01T00:00:00Z"


@query(f"{_W} SELECT id, coalesce(valid_to, CASE WHEN source_doc % 8 = 3 THEN '{_AT}' END) AS valid_to FROM edges")
def life_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return U.retired(e, e.filter("source_doc % 8 = 3").select(F.col("source_doc").alias("doc_id")), _AT).select("id", "valid_to")


@query(f"{_W} SELECT id, coalesce(valid_to, CASE WHEN source_doc % 8 = 3 AND source_doc % 16 <> 3 THEN '{_AT}' END) AS valid_to FROM edges")
def life_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the retired documents come back; only what their retirement ended opens again."""
    e = edges(spark, sf_dir)
    docs = e.select(F.col("source_doc").alias("doc_id"))
    return U.restored(U.retired(e, docs.filter("doc_id % 8 = 3"), _AT), docs.filter("doc_id % 16 = 3"), _AT).select("id", "valid_to")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents QUALIFY doc_id <> first")
def life_cleanup_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cleanup_set(table(spark, sf_dir, "documents"), F.sha2("text", 256))


@query("SELECT source, count(*) FILTER (doc_id % 5 < 2) AS open, count(*) FILTER (doc_id % 5 BETWEEN 2 AND 3) AS private, count(*) FILTER (doc_id % 5 = 4) AS undecided FROM documents GROUP BY source")
def life_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(k < 2).alias("open"), F.count_if(k.between(2, 3)).alias("private"), F.count_if(k == 4).alias("undecided"))


@query(f"{_W} SELECT id, to_json({{id: id, src: src, rel: rel, dst: dst, source_doc: source_doc}})::VARCHAR AS line FROM edges WHERE source_doc IN (SELECT source_doc FROM edges WHERE dst = 3)")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all documents that speak of one entity, as JSON lines."""
    e = edges(spark, sf_dir)
    held = e.join(e.filter("dst = 3").select("source_doc").distinct(), "source_doc", "left_semi")
    return U.as_lines(held, ["id", "src", "rel", "dst", "source_doc"])


@query(f"{_W} SELECT id, src, rel, dst FROM edges")
def graph_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export's lines give back; broken lines are left out."""
    lines = U.as_lines(edges(spark, sf_dir), ["id", "src", "rel", "dst"]).select("line")
    return U.from_lines(lines.unionByName(spark.createDataFrame([("{broken",), ("[]",)], "line string")), "id bigint, src bigint, rel string, dst bigint")


@query(f"{_W} SELECT id, CASE WHEN src % 4 = 1 OR dst % 4 = 1 THEN 'held' WHEN src % 4 <> 2 AND dst % 4 <> 2 THEN 'in' ELSE 'new' END AS state FROM edges")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    ids = e.select(F.col("src").alias("gid")).unionByName(e.select(F.col("dst").alias("gid"))).distinct().filter("gid % 4 <> 2")
    return U.landed(e.select("id", "src", "dst"), ids.withColumn("how", F.when(F.col("gid") % 4 == 1, "likely").otherwise("gid")))


@query("SELECT user_id AS gid, verdict FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'undo' ELSE event_type END AS verdict, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 AND verdict <> 'undo'")
def import_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("gid"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "undo").otherwise(F.col("event_type")).alias("verdict"))
    return U.standing(rows, ["gid"]).select("gid", "verdict")


@query(f"{_W}, m AS (SELECT DISTINCT source_doc AS doc, src AS entity FROM edges), o AS (SELECT entity FROM m WHERE doc = 5) SELECT doc, count(*) AS shared FROM m WHERE doc <> 5 AND entity IN (FROM o) GROUP BY doc ORDER BY shared DESC, doc LIMIT 10")
def graph_document_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = edges(spark, sf_dir).select(F.col("source_doc").alias("doc"), F.col("src").alias("entity"))
    return U.shared_context(members, 5, 10)


@query(f"{_W} SELECT DISTINCT source_doc AS doc FROM edges WHERE dst = 4 UNION SELECT doc_id FROM documents WHERE source = 'src2' AND doc_id < 100000 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def graph_seed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to start from: those that speak of an entity, of a domain, or with a tag."""
    named = edges(spark, sf_dir).filter("dst = 4").select(F.col("source_doc").alias("doc"))
    domain = table(spark, sf_dir, "documents").filter("source = 'src2' AND doc_id < 100000").select(F.col("doc_id").alias("doc"))
    return named.unionByName(domain).unionByName(table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("doc"))).distinct()


@query(f"{_W} SELECT src AS person, rel, count(*) AS facts, count(DISTINCT source_doc) AS docs, min(valid_from) AS first FROM edges WHERE src BETWEEN 10000 AND 9999999 GROUP BY src, rel")
def graph_person_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = edges(spark, sf_dir).filter("src BETWEEN 10000 AND 9999999")
    return held.groupBy(F.col("src").alias("person"), "rel").agg(F.count("*").alias("facts"), F.count_distinct("source_doc").alias("docs"), F.min("valid_from").alias("first"))


@query("WITH c AS (SELECT substr(p_name, 1, 1) AS acronym, p_name AS phrase, count(*) AS docs FROM part WHERE p_size % 3 = 0 OR p_name < 'm' GROUP BY ALL), r AS (SELECT *, lead(docs) OVER w AS nxt, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY acronym ORDER BY docs DESC, phrase)) SELECT acronym, phrase FROM r WHERE rn = 1 AND (nxt IS NULL OR docs >= 1.05 * nxt)")
def resolve_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An abbreviation into the phrase that clearly leads among those it is defined as."""
    counts = table(spark, sf_dir, "part").filter("p_size % 3 = 0 OR p_name < 'm'").groupBy(F.substring("p_name", 1, 1).alias("acronym"), F.col("p_name").alias("phrase")).agg(F.count("*").alias("docs"))
    return U.leading_phrases(counts, 1.05)


_PAIRS_SQL = "pr AS (SELECT a.p_partkey AS id, a.p_name || ' ' || a.p_partkey % 3 AS a, b.p_name || ' ' || b.p_partkey % 3 AS b, a.p_brand AS type_a, b.p_brand AS type_b, a.p_size AS degree_a, b.p_size AS degree_b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 3 + a.p_partkey % 2)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate merges: each part with one a few places on."""
    part = table(spark, sf_dir, "part")
    side = lambda x: [F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 3).cast("string")).alias(x), F.col("p_brand").alias(f"type_{x}"), F.col("p_size").alias(f"degree_{x}")]
    left = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 3 + F.col("p_partkey") % 2).alias("_k"), *side("a"))
    return left.join(part.select(F.col("p_partkey").alias("_k"), *side("b")), "_k").drop("_k")


@query(f"WITH {_PAIRS_SQL}, r AS (SELECT id, CASE WHEN type_a <> type_b AND id % 2 = 0 THEN 'type' WHEN substr(a, -1) <> substr(b, -1) THEN 'numbers' WHEN least(degree_a, degree_b) >= 20 THEN 'connected' END AS risk FROM pr) SELECT id, risk FROM r WHERE risk IS NOT NULL")
def resolve_merge_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return U.merge_risk(pairs.withColumn("type_b", F.when(F.col("id") % 2 == 0, F.col("type_b")).otherwise(F.col("type_a"))))


@query(f"WITH {_PAIRS_SQL} SELECT id FROM pr WHERE len(list_intersect(string_split(lower(a), ' '), string_split(lower(b), ' '))) = 0 ORDER BY least(degree_a, degree_b) DESC, id LIMIT 30")
def resolve_suspect_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of names without a word in common, the best connected first."""
    odd = _pairs(spark, sf_dir).filter(U.no_common_word(F.col("a"), F.col("b")))
    return odd.orderBy(F.desc(F.least("degree_a", "degree_b")), "id").limit(30).select("id")


@query("""WITH g AS (SELECT p_partkey AS id, list_distinct(list_transform(range(1, len(p_name) + 1), lambda i: substr(' ' || lower(p_name) || ' ', i, 3))) AS g FROM part), q AS (SELECT list_distinct(list_transform(range(1, 11), lambda i: substr(' small gear ', i, 3))) AS q)
SELECT id, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS jaccard FROM g, q ORDER BY jaccard DESC, id LIMIT 8""")
def resolve_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.precedents(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "small gear", 8)


@query("""WITH o AS (SELECT c_nationkey AS g, c_custkey AS m FROM customer), n AS (SELECT CASE WHEN c_custkey % 29 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS g, c_custkey AS m FROM customer WHERE c_custkey % 31 <> 4) SELECT coalesce(o.g, n.g) AS "group", count(*) AS changed FROM o FULL JOIN n ON o.g = n.g AND o.m = n.m WHERE o.g IS NULL OR n.g IS NULL GROUP BY 1""")
def community_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("member"))
    new = c.filter("c_custkey % 31 <> 4").select(F.when(F.col("c_custkey") % 29 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("group"), F.col("c_custkey").alias("member"))
    return U.stale_groups(old, new)


@query("WITH c AS (SELECT user_id AS address, floor(epoch(ts))::BIGINT AS s, event_id AS id FROM events), g AS (SELECT *, coalesce(s - lag(s) OVER w > 7200, true) AS new FROM c WINDOW w AS (PARTITION BY address ORDER BY s, id)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY address ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT address, arg_min(id, (s, id)) AS first, count(*) AS n FROM r GROUP BY address, run")
def stream_folded_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of one address within two hours of the one before count as one."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("address"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return U.folded_captures(rows, 7200)


@query("SELECT p_partkey AS town, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ', ' || p_type ELSE name END AS label FROM (SELECT p_partkey, p_type, CASE WHEN p_size < 30 THEN p_name ELSE p_name || p_partkey END AS name FROM part)")
def geo_towns_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") < 30, F.col("p_name")).otherwise(F.concat("p_name", F.col("p_partkey").cast("string")))
    return U.apart(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("town"), name.alias("name"), F.col("p_type").alias("region")))


@query("SELECT doc_id, md5(text || ' fine flat office \"so\" it''s') AS hash FROM documents WHERE NOT regexp_matches(text, '[ﬁﬂﬀﬃﬄ’“”\u00ad\u00a0]')")
def text_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(~F.col("text").rlike("[ﬁﬂﬀﬃﬄ’“”­ ]"))
    return docs.select("doc_id", F.md5(U.clean_glyphs(F.concat("text", F.lit(" ﬁne ﬂat oﬃce “so” it’s")))).alias("hash"))


@query("SELECT p_partkey AS id, p_partkey % 3 <> 2 AS comments FROM part")
def text_comment_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" Comments on this"))).when(k % 3 == 1, F.lit(" Leave a Reply")).otherwise(F.concat(F.lit("On comments "), F.col("p_name")))
    return table(spark, sf_dir, "part").select(k.alias("id"), U.comment_heading(title).alias("comments"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '2019-05-01' WHEN page_id % 2 = 0 THEN '2018-03' WHEN page_id % 3 = 0 THEN '2017' END AS published FROM pages")
def page_tag_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, tag = F.col("page_id"), lambda name, value: F.lit(f'<meta name="{name}" content="{value}">')
    made = F.concat(F.when(k % 3 == 0, tag("date", "2017")).otherwise(""), F.when(k % 2 == 0, tag("article:published_time", "2018-03")).otherwise(""), F.when(k % 4 == 0, tag("citation_date", "2019-05-01")).otherwise(""), "html")
    return table(spark, sf_dir, "pages").select("page_id", U.tag_date(made).alias("published"))


@query("WITH t AS (SELECT doc_id, list(DISTINCT n ORDER BY n) AS h FROM (SELECT l_orderkey AS doc_id, l_shipdate, 'n' || l_partkey % 50 AS n FROM lineitem) GROUP BY doc_id) SELECT doc_id, len(h) AS titles FROM t WHERE len(h) > 1")
def label_title_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had several titles; each retitling is a row."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("n"), (F.col("l_partkey") % 50).cast("string")).alias("n"))
    return rows.groupBy("doc_id").agg(F.count_distinct("n").alias("titles")).filter("titles > 1")


@query("SELECT user_id AS face, event_type AS person, strftime(ts, '%Y-%m-%d %H:%M:%S') AS given, strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), '%Y-%m-%d %H:%M:%S') AS ended FROM events")
def face_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers about each face: one ends when the next is given, none is overwritten."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("face"), F.col("event_type").alias("person"), text("ts").alias("given"), text(F.lead("ts").over(w)).alias("ended"))


@query(f"{_W}, q AS (SELECT e.id, s.type AS a, t.type AS b FROM edges e JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE rel = 'located_in') SELECT a, b, count(*) AS n, a = 'supplier' AND b = 'nation' AS fits FROM q GROUP BY a, b")
def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined edges against newer rules: which of them fit now."""
    types = nodes(spark, sf_dir).select("id", "type")
    held = edges(spark, sf_dir).filter("rel = 'located_in'").join(types.select(F.col("id").alias("src"), F.col("type").alias("a")), "src").join(types.select(F.col("id").alias("dst"), F.col("type").alias("b")), "dst")
    rules = spark.createDataFrame([("supplier", "nation", True)], "a string, b string, fits boolean")
    return held.groupBy("a", "b").agg(F.count("*").alias("n")).join(F.broadcast(rules), ["a", "b"], "left").select("a", "b", "n", F.coalesce("fits", F.lit(False)).alias("fits"))
