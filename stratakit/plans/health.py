"""The quality checks over tables that are derived from the star schema, and the evaluation of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.operators import checks as C
from stratakit.operators import dedupe as U
from stratakit.operators import search as S
from stratakit.plans.base import query, table
from stratakit.plans.graphs import NODES_SQL, edges, nodes
from stratakit.plans.retrieval import TOKENS_SQL


def _tables(spark: SparkSession, sf_dir: str) -> C.Tables:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        i, "text", "n_chars", F.when(i % 9 != 7, F.element_at(F.array(*map(F.lit, ("application/pdf", "text/html", "video/mp4"))), (i % 3 + 1).cast("int"))).alias("mime"),
        (i % 41).alias("pages"), F.when(i % 4 != 0, i % 7).alias("stamp"), (i % 13 == 4).alias("retired"),
    )
    e = edges(spark, sf_dir).withColumn("producer", F.lit("reader"))
    moved = e.filter("rel = 'located_in' AND id % 5 = 0").withColumn("dst", F.when(F.col("id") % 10 == 0, F.col("src")).otherwise(F.col("dst") + 1)).withColumn("id", F.col("id") + 50_000)
    events = table(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 20_000_000).alias("id"), F.when(F.col("p_partkey") % 50 == 0, "").when(F.col("p_partkey") % 50 == 1, F.concat("p_name", F.lit("\t"))).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("type"))
    return C.Tables(
        nodes(spark, sf_dir).unionByName(parts), e.unionByName(moved), docs, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")),
        table(spark, sf_dir, "labels").select((F.col("doc_id") * 10).alias("id"), "doc_id"), events.select(F.col("event_id").alias("id"), seconds.alias("beat"), F.lit(1_704_200_000).alias("now")),
    )


_TABLES_SQL = f"""{NODES_SQL}, ent AS (FROM nodes UNION ALL SELECT p_partkey + 20000000, CASE p_partkey % 50 WHEN 0 THEN '' WHEN 1 THEN p_name || chr(9) ELSE p_name END, p_type FROM part),
docs AS (SELECT doc_id, text, n_chars, CASE WHEN doc_id % 9 <> 7 THEN ['application/pdf', 'text/html', 'video/mp4'][doc_id % 3 + 1] END AS mime, doc_id % 41 AS pages, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 7 END AS stamp, doc_id % 13 = 4 AS retired FROM documents),
eds AS (SELECT id, src, rel, dst, source_doc, valid_to FROM edges UNION ALL SELECT id + 50000, src, rel, CASE WHEN id % 10 = 0 THEN src ELSE dst + 1 END, source_doc, valid_to FROM edges WHERE rel = 'located_in' AND id % 5 = 0)"""


@query(f"""WITH {_TABLES_SQL}, live AS (SELECT * FROM docs WHERE NOT retired), held AS (SELECT * FROM eds WHERE valid_to IS NULL), keyed AS (SELECT *, regexp_replace(trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '(\\b[\\p{{L}}\\p{{N}}]{{4,}})s$', '\\1') AS k FROM ent), found AS (
SELECT 'functional-conflicts' AS "check", src AS id FROM held WHERE rel IN ('located_in', 'part_of') GROUP BY src, rel HAVING count(DISTINCT dst) > 1
UNION ALL SELECT 'self-edges', id FROM held WHERE src = dst
UNION ALL SELECT 'duplicate-facts', min(id) FROM held WHERE source_doc IS NOT NULL GROUP BY src, rel, dst, source_doc HAVING count(*) > 1
UNION ALL SELECT 'placeholder-entities', id FROM ent WHERE regexp_matches(lower(name), '^(unknown|none|n/?a|tbd|anonymous|untitled|customer#0+)$')
UNION ALL SELECT 'reference-number-entities', id FROM ent WHERE regexp_matches(name, '^\\[?[0-9]{{1,4}}\\]?$|#0*[0-9]{{2}}$')
UNION ALL SELECT 'mangled-names', id FROM ent WHERE contains(name, chr(9)) OR regexp_matches(name, '\\s\\s')
UNION ALL SELECT 'unnamed-entities', id FROM ent WHERE name IS NULL OR trim(name) = ''
UNION ALL SELECT 'split-names', min(id) FROM ent GROUP BY lower(name) HAVING count(DISTINCT type) > 1
UNION ALL SELECT 'edges-of-retired-documents', id FROM held WHERE source_doc IN (SELECT doc_id FROM docs WHERE retired)
UNION ALL SELECT 'review-of-retired-documents', doc_id * 10 FROM labels WHERE doc_id IN (SELECT doc_id FROM docs WHERE retired)
UNION ALL SELECT 'stale-jobs', event_id FROM events WHERE floor(epoch(ts)) < 1704200000 - 3600
UNION ALL SELECT 'twin-documents', min(doc_id) FROM live GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'untyped-documents', doc_id FROM live WHERE mime IS NULL
UNION ALL SELECT 'uncounted-pages', doc_id FROM live WHERE mime = 'application/pdf' AND pages = 0
UNION ALL SELECT 'thin-texts', doc_id FROM live WHERE mime = 'application/pdf' AND pages >= 5 AND n_chars / pages < 100
UNION ALL SELECT 'unreadable-documents', doc_id FROM live WHERE len(regexp_replace(text, '\\s', '', 'g')) > 2 * len(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))
UNION ALL SELECT 'stale-extractions', doc_id FROM live WHERE stamp < 5
UNION ALL SELECT 'documents-without-an-extractor', doc_id FROM live WHERE stamp IS NULL AND mime LIKE 'video/%'
UNION ALL SELECT 'chunks-without-vectors', doc_id FROM live WHERE len(text) > 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'wire-names', id FROM ent WHERE contains(name, chr(9)) OR contains(name, '|')
UNION ALL SELECT 'document-twins', min(id) FROM keyed GROUP BY type, k HAVING count(*) > 1)
SELECT "check", count(*) AS n, min(id)::BIGINT AS first FROM found GROUP BY 1""")
def checks_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bad rows each check finds, and the first."""
    found = C.findings(_tables(spark, sf_dir), [n for n in C.CHECKS if n not in ("spacing-twins", "unmapped-glyphs", "damaged-names")])
    return found.groupBy("check").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_EVAL_SQL = f"""t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents), stats AS (SELECT count(*) AS n, avg(len(t)) AS av FROM t), p AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM q JOIN p USING (term) JOIN df USING (term), stats GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM s QUALIFY place <= 100),
bg AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) AS i FROM (SELECT item_id, {TOKENS_SQL} AS t FROM benchmark))),
dg AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) AS i FROM t)), c AS (SELECT item_id, count(*) AS k FROM bg GROUP BY item_id),
e AS (SELECT item_id, doc_id FROM bg JOIN dg USING (g) JOIN c USING (item_id) GROUP BY item_id, doc_id HAVING count(*) >= 0.9 * any_value(k)), best AS (SELECT item_id, min(place) AS p FROM e LEFT JOIN r USING (item_id, doc_id) GROUP BY item_id)"""


@query(f"WITH {_EVAL_SQL} SELECT count(*) AS queries, round(avg(coalesce((p <= 1)::INT, 0)), 6) AS hit1, round(avg(coalesce((p <= 3)::INT, 0)), 6) AS hit3, round(avg(coalesce(1.0 / p, 0)), 6)::DOUBLE AS mrr FROM best")
def search_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item as a query of all its words; the documents that hold nine tenths of its 5-grams are expected."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    asked = items.select(F.col("item_id").alias("query"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    scored = S.bm25_batch(S.stored_index(docs), asked)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc_id")
    ranked = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= S.RRF_DEPTH)
    grams = lambda frame, key, name: frame.select(F.col(key).alias(name), F.explode(U.shingle_hashes(F.col("text"))).alias("g"))
    own = grams(items, "item_id", "query")
    sizes = own.groupBy("query").agg(F.count("*").alias("_k"))
    held = own.join(grams(docs, "doc_id", "doc_id"), "g").groupBy("query", "doc_id").agg(F.count("*").alias("_c")).join(sizes, "query").filter("_c >= 0.9 * _k")
    out = S.evaluate(ranked.select("query", "doc_id", "place"), held.select("query", "doc_id"))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "mrr")])
