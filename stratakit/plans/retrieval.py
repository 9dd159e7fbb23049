"""Search and listing over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.operators import documents as D
from stratakit.operators import search as S
from stratakit.plans.base import query, table

TERMS = ["the", "tion", "haen", "ver", "erth"]
_T = ", ".join(f"'{t}'" for t in TERMS)
TOKENS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
BM25_SQL = f"""
toks AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS av FROM toks),
tf AS (SELECT doc_id, term, len(t) AS dl, len(list_filter(t, lambda x: x = term))::BIGINT AS tf FROM toks, (SELECT unnest([{_T}]) AS term)),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score, count(*) AS n_terms
  FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY doc_id)"""
#: Documents stand for vectors by id, an explicitly synthetic pairing: vector v belongs to document v.
KNN_SQL = """
dot AS (SELECT b.vec_id, a.vec_id AS query, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS similarity
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def search_bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top(S.bm25_stored(S.stored_index(_docs(spark, sf_dir)), TERMS), 20).select("doc_id", F.round("score", 5).alias("score"))


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 5) AS score FROM bm WHERE n_terms = {len(TERMS)}")
def search_bm25_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25_stored(S.stored_index(_docs(spark, sf_dir)), TERMS, all_terms=True).select("doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {BM25_SQL.replace("FROM documents", "FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1')")} SELECT doc_id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20""")
def search_bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = _docs(spark, sf_dir).filter("lang = 'en' AND source IN ('src0', 'src1')")
    return S.top(S.bm25(scope, TERMS), 20).select("doc_id", F.round("score", 5).alias("score"))


@query(rf"""SELECT doc_id, (len(j) - len(replace(j, ' of  the ', '')))::BIGINT // 9 AS n FROM (SELECT doc_id, ' ' || array_to_string({TOKENS_SQL}, '  ') || ' ' AS j FROM documents) WHERE contains(j, ' of  the ')""")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.phrase(_docs(spark, sf_dir), ["of", "the"])


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term")
def search_postings_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT least(df, 50) AS df_capped, count(*) AS terms FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term) GROUP BY ALL")
def search_df_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.document_frequency(S.postings(_docs(spark, sf_dir)))
    return df.groupBy(F.least("df", F.lit(50)).alias("df_capped")).agg(F.count("*").alias("terms"))


@query(f"""WITH df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term)
SELECT term, df FROM df WHERE df < 50 AND (len(term) <= 6 OR regexp_matches(term, '[0-9]'))""")
def search_rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.document_frequency(S.postings(_docs(spark, sf_dir)))
    return df.filter((F.col("df") < 50) & ((F.length("term") <= 6) | F.col("term").rlike("[0-9]")))


@query(f"""WITH df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term),
words AS (SELECT term, unnest(range(3, len(term) - 2)) AS cut FROM df WHERE len(term) >= 8 AND regexp_matches(term, '^[a-z]+$') AND df = 1),
parts AS (SELECT w.term, cut, substr(w.term, 1, cut) AS head, substr(w.term, cut + 1) AS tail FROM words w)
SELECT p.term, arg_max(head, cut) AS head, arg_max(tail, cut) AS tail FROM parts p JOIN df h ON p.head = h.term AND h.df >= 3 JOIN df t ON p.tail = t.term AND t.df >= 3 GROUP BY p.term""")
def search_compound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of one document as two words that three documents or more hold; the rightmost cut."""
    df = S.document_frequency(S.postings(_docs(spark, sf_dir)))
    words = df.filter((F.length("term") >= 8) & F.col("term").rlike("^[a-z]+$") & (F.col("df") == 1))
    cuts = words.select("term", F.explode(F.sequence(F.lit(3), F.length("term") - 3)).alias("cut"))
    parts = cuts.select("term", "cut", F.substring("term", F.lit(1), F.col("cut")).alias("head"), F.substring("term", F.col("cut") + 1, F.length("term")).alias("tail"))
    common = df.filter("df >= 3").select(F.col("term").alias("w"))
    held = parts.join(common, F.col("head") == F.col("w")).drop("w").join(common, F.col("tail") == F.col("w")).drop("w")
    return held.groupBy("term").agg(F.max_by("head", "cut").alias("head"), F.max_by("tail", "cut").alias("tail"))


@query(f"""WITH df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term),
forms AS MATERIALIZED (SELECT term, df, term || unnest(['s', 'es', 'e', 'n', 'en', 'er']) AS form FROM df WHERE df < 50 AND len(term) >= 4),
j AS (SELECT f.term, f.form, g.df AS form_df, f.df FROM forms f JOIN df g ON f.form = g.term)
SELECT term, form, form_df FROM j WHERE form_df >= 3 AND form_df < greatest(50, 10 * df) QUALIFY row_number() OVER (PARTITION BY term ORDER BY form_df DESC, form) <= 3""")
def search_inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.document_frequency(S.postings(_docs(spark, sf_dir)))
    endings = F.array(*map(F.lit, ["s", "es", "e", "n", "en", "er"]))
    forms = df.filter((F.col("df") < 50) & (F.length("term") >= 4)).select("term", "df", F.explode(F.transform(endings, lambda e: F.concat("term", e))).alias("form"))
    known = df.select(F.col("term").alias("form"), F.col("df").alias("form_df"))
    held = forms.join(known, "form").filter((F.col("form_df") >= 3) & (F.col("form_df") < F.greatest(F.lit(50), 10 * F.col("df"))))
    three = held.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("form_df"), "form")))
    return three.filter("_r <= 3").select("term", "form", "form_df")


@query(f"WITH {KNN_SQL} SELECT query, vec_id, round(similarity, 5) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS place FROM dot) WHERE place <= 10")
def search_knn_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.knn(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10)
    return out.select("query", "vec_id", F.round("similarity", 5).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL)
SELECT label, i::BIGINT AS i, round(m, 6) AS m FROM c""")
def search_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m")).select("label", F.col("i").cast("long").alias("i"), "m")


HYBRID_SQL = f"""WITH {BM25_SQL}, {KNN_SQL},
kw AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 0 AS list, 1.0::DOUBLE AS w FROM bm QUALIFY place <= 100),
vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS place, 1 AS list, 2.0::DOUBLE AS w FROM dot WHERE query = 0 QUALIFY place <= 100),
fused AS (SELECT doc_id, sum(w / (60 + place)) AS score, min(list * 1000 + place) AS first, count(*) AS n_lists FROM (FROM kw UNION ALL FROM vec) GROUP BY doc_id),
ranked AS (SELECT doc_id, score, n_lists, row_number() OVER (ORDER BY round(score, 9) DESC, first, doc_id) AS place FROM fused),
library AS (SELECT source, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY source)"""


@query(HYBRID_SQL + " SELECT doc_id, round(score, 7) AS score, n_lists, place FROM ranked WHERE place <= 20")
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: keyword and vector lists fused by document."""
    return _hybrid(spark, sf_dir).filter("place <= 20").select("doc_id", F.round("score", 7).alias("score"), "n_lists", "place")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = S.places(S.bm25_stored(S.stored_index(_docs(spark, sf_dir)), TERMS), S.RRF_DEPTH)
    near = S.knn(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir).filter("query = 0"), S.RRF_DEPTH).select(F.col("vec_id").alias("doc_id"), "place")
    fused = S.fuse([(words, 1.0), (near, S.field_weight(2))])
    order = Window.orderBy(F.desc(F.round("score", 9)), "first_list", "first_place", "doc_id")  # at most two lists' depth of rows
    return fused.withColumn("place", F.row_number().over(order).cast("long"))


@query(HYBRID_SQL + """, stale AS (SELECT *, doc_id % 3 = 0 AS stale FROM ranked WHERE place <= 25)
SELECT doc_id, stale, row_number() OVER (ORDER BY place + CASE WHEN stale THEN 5.5 ELSE 0 END, place) AS place FROM stale""")
def search_stale_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hybrid(spark, sf_dir).filter("place <= 25").withColumn("stale", F.col("doc_id") % 3 == 0)
    return S.shift_stale(hits).select("doc_id", "stale", F.col("new_place").cast("long").alias("place"))


@query(HYBRID_SQL + """, hits AS (SELECT r.*, source FROM ranked r JOIN documents USING (doc_id) WHERE place <= 40),
votes AS (SELECT source, count(*) AS v FROM hits JOIN library USING (source) WHERE place <= 30 AND share < 0.2 GROUP BY source HAVING count(*) >= 3),
sole AS (SELECT min(source) AS source FROM votes WHERE v = (SELECT max(v) FROM votes) HAVING count(*) = 1)
SELECT doc_id, round(CASE WHEN s.source IS NULL THEN 0 ELSE 1 / (60 + row_number() OVER (PARTITION BY s.source ORDER BY place)) END, 8)::DOUBLE AS prior FROM hits h LEFT JOIN sole s ON h.source = s.source""")
def search_domain_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    library = docs.groupBy(F.col("source").alias("domain")).agg(F.count("*").alias("n")).join(F.broadcast(docs.agg(F.count("*").alias("all"))))
    hits = _hybrid(spark, sf_dir).filter("place <= 40").join(docs.select("doc_id", F.col("source").alias("domain")), "doc_id")
    out = S.domain_prior(hits, library.select("domain", (F.col("n") / F.col("all")).alias("share")))
    return out.select("doc_id", F.round("prior", 8).alias("prior"))


WINDOWS_SQL = "(SELECT doc_id, i AS seq, i * 850 AS start, least(len(text), i * 850 + 1000) AS \"end\", substr(text, i * 850 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((len(text) - 1000) / 850))::BIGINT + 1)) AS i FROM documents WHERE len(text) > 0))"


@query(f"SELECT doc_id, seq, start, \"end\", md5(text) AS hash FROM {WINDOWS_SQL}")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.chunks(_docs(spark, sf_dir))
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("hash"))


@query(f"SELECT doc_id, seq FROM (SELECT doc_id, seq, row_number() OVER w AS rn, sum(len(text)) OVER w AS total FROM {WINDOWS_SQL} WHERE seq > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) WHERE total <= 1500 OR rn = 1")
def doc_read_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read_on(D.chunks(_docs(spark, sf_dir)), 0, 1500).select("doc_id", F.col("seq").cast("long").alias("seq"))


@query(rf"""SELECT doc_id, arg_min(seq, (-s) * 1000000 + seq) AS seq, max(s)::BIGINT AS score FROM (SELECT doc_id, seq, coalesce(list_sum(list_transform(list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')), lambda x: x IN ({_T})), lambda x: len(x))), 0) AS s FROM {WINDOWS_SQL}) GROUP BY doc_id""")
def doc_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.best_chunk(D.chunks(_docs(spark, sf_dir)), TERMS)
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("score").cast("long").alias("score"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'de' AND n_chars >= 500 AND doc_id % 11 <> 0 ORDER BY n_chars DESC, doc_id DESC LIMIT 25 OFFSET 10")
def doc_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).filter("lang = 'de' AND n_chars >= 500 AND doc_id % 11 <> 0").select("doc_id", "source", "n_chars")
    return D.page(rows, [F.desc("n_chars"), F.desc("doc_id")], 25, 10)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def doc_facet_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.facet(_docs(spark, sf_dir), "lang")


@query("SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang <> 'en') AS n_other FROM documents GROUP BY source")
def doc_language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("lang") != "en").alias("n_other"))


@query("SELECT CASE WHEN n_chars > 5000 THEN 'long' WHEN lang = 'de' THEN 'german' WHEN contains(lower(text), '@') THEN 'mail' ELSE 'rest' END AS rule, count(*) AS n, list_sort(list(doc_id))[1:3] AS examples FROM documents GROUP BY ALL")
def doc_rule_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = D.first_rule([(F.col("n_chars") > 5000, "long"), (F.col("lang") == "de", "german"), (D.title_contains(F.col("text"), "@"), "mail")], "rest")
    ids = _docs(spark, sf_dir).select(rule.alias("rule"), "doc_id")
    three = ids.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("doc_id"))).filter("_r <= 3").groupBy("rule").agg(F.sort_array(F.collect_list("doc_id")).alias("examples"))
    return D.facet(ids, "rule").join(three, "rule")


@query("SELECT substr(text, 1, 12) AS title, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) >= 3")
def doc_shared_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.shared_titles(_docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 12).alias("title")), "title", 3)


@query("SELECT count(*) AS n, sum(('0x' || substr(md5(doc_id::VARCHAR || '|' || text), 1, 8))::BIGINT)::BIGINT AS checksum FROM documents")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fingerprint(_docs(spark, sf_dir), ["doc_id", "text"])


@query("SELECT count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(*) FILTER (n_chars < 200) AS short, max(doc_id) AS newest FROM documents")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_if(F.col("n_chars") < 200).alias("short"), F.max("doc_id").alias("newest"))


@query("""SELECT doc_id, quality, source FROM (SELECT d.doc_id, quality, source, row_number() OVER (PARTITION BY quality, lang ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id) WHERE r <= 3""")
def doc_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _docs(spark, sf_dir).select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    w = Window.partitionBy("quality", "lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return joined.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("doc_id", "quality", "source")


@query("SELECT d.doc_id, quality, toxic, substr(text, 1, 2200) AS opening FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def doc_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").filter("quality IS NOT NULL"), "doc_id")
    return joined.select("doc_id", "quality", "toxic", F.substring("text", 1, 2200).alias("opening"))


@query(rf"""WITH w AS (SELECT doc_id, seq, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM {WINDOWS_SQL}),
runs AS (SELECT doc_id, seq, i, array_to_string(t[i + 1:i + 6], ' ') AS phrase FROM (SELECT doc_id, seq, t, unnest(range(0, len(t) - 5)) AS i FROM w WHERE len(t) >= 8)),
once AS (SELECT doc_id, phrase, min(seq) AS seq, min(i) AS i FROM runs GROUP BY doc_id, phrase HAVING count(DISTINCT seq) = 1)
SELECT doc_id, seq AS chunk, arg_min(phrase, i) AS phrase FROM once GROUP BY doc_id, seq""")
def search_unique_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = D.chunks(_docs(spark, sf_dir)).select("doc_id", F.col("seq").cast("long").alias("chunk"), "text")
    return S.unique_phrases(passages, 6)
