"""Text rules, query expansion and session variants over the given tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.operators import knowledge as K
from stratakit.operators import search as S
from stratakit.operators import words as W
from stratakit.plans.base import query, table
from stratakit.plans.retrieval import BM25_SQL, TERMS, TOKENS_SQL, WINDOWS_SQL


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(rf"WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM benchmark), k AS (SELECT item_id, t, list_filter(t, lambda x: len(x) > 1 AND x NOT IN ({_STOP})) AS kept FROM q) SELECT item_id, array_to_string(list_sort(CASE WHEN len(kept) > 0 THEN kept ELSE t END), ' ') AS terms FROM k")
def search_keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.keyword_terms(F.col("text"))), " ").alias("terms"))


_ARXIV_SQL = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'see arXiv:' || lpad((doc_id % 30)::VARCHAR, 2, '0') || lpad((doc_id % 15)::VARCHAR, 2, '0') || '.1' || lpad((doc_id % 1000)::VARCHAR, 4, '0') || 'v3 there' WHEN 1 THEN 'https://doi.org/10.1234/AB.' || doc_id WHEN 2 THEN 'doi: 10.99/x' || doc_id ELSE 'none of ' || doc_id END AS said FROM documents)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    two = lambda n: F.lpad((i % n).cast("string"), 2, "0")
    arxiv = F.concat(F.lit("see arXiv:"), two(30), two(15), F.lit(".1"), F.lpad((i % 1000).cast("string"), 4, "0"), F.lit("v3 there"))
    said = F.when(i % 4 == 0, arxiv).when(i % 4 == 1, F.concat(F.lit("https://doi.org/10.1234/AB."), i.cast("string"))).when(i % 4 == 2, F.concat(F.lit("doi: 10.99/x"), i.cast("string")))
    return _docs(spark, sf_dir).select("doc_id", said.otherwise(F.concat(F.lit("none of "), i.cast("string"))).alias("said"))


@query(f"SELECT doc_id, nullif(regexp_extract(said, '([0-9]{{4}}\\.[0-9]{{4,5}})', 1), '') AS arxiv, CASE WHEN doc_id % 4 = 0 AND doc_id % 15 BETWEEN 1 AND 12 THEN '20' || lpad((doc_id % 30)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 15)::VARCHAR, 2, '0') END AS month FROM {_ARXIV_SQL} WHERE doc_id % 4 = 0")
def text_arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir).filter("doc_id % 4 = 0").withColumn("arxiv", T.arxiv_id(F.col("said")))
    return rows.select("doc_id", "arxiv", T.arxiv_month(F.col("arxiv")).alias("month"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '10.1234/ab.' || doc_id END AS doi, CASE WHEN doc_id % 4 = 1 THEN '10.1234/AB.' || doc_id END AS of_url FROM {_ARXIV_SQL}")
def text_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix of fewer than four digits is none."""
    return _said(spark, sf_dir).select("doc_id", T.normal_doi(F.col("said")).alias("doi"), T.doi_of_url(F.col("said")).alias("of_url"))


@query("WITH b AS (SELECT c_custkey AS id, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') || lpad((c_custkey * 104729 % 10000000000)::VARCHAR, 10, '0') AS bban FROM customer), k AS (SELECT id, bban, 98 - (bban || '131400')::HUGEINT % 97 AS good FROM b) SELECT id, id % 3 <> 0 OR lpad((good % 97 + 1)::VARCHAR, 2, '0') = lpad(good::VARCHAR, 2, '0') AS ok FROM k")
def text_ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits of made account numbers; every third has wrong ones."""
    k = F.col("c_custkey")
    bban = F.concat(F.lpad((k * 7919 % 100_000_000).cast("string"), 8, "0"), F.lpad((k * 104_729 % 10_000_000_000).cast("string"), 10, "0"))
    good = 98 - F.concat(bban, F.lit("131400")).cast("decimal(30,0)") % 97
    said = F.lpad(F.when(k % 3 == 0, good % 97 + 1).otherwise(good).cast("int").cast("string"), 2, "0")
    return table(spark, sf_dir, "customer").select(k.alias("id"), T.iban_ok(F.concat(F.lit("DE"), said, bban)).alias("ok"))


@query("""WITH d AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, o_orderkey % 6 AS form FROM orders) SELECT id, CASE form WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%Y-%m') WHEN 4 THEN strftime(d, '%Y') END AS value, CASE form WHEN 0 THEN 'day' WHEN 1 THEN 'day' WHEN 2 THEN 'day' WHEN 3 THEN 'month' WHEN 4 THEN 'year' END AS precision FROM d""")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as people write them: ISO, "3 July 2019", "July 3, 2019", "July 2019", a year, and none."""
    d, form = F.col("o_orderdate"), F.col("o_orderkey") % 6
    written = (
        F.when(form == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm")).when(form == 1, F.date_format(d, "d MMMM yyyy")).when(form == 2, F.date_format(d, "MMM d, yyyy"))
        .when(form == 3, F.date_format(d, "MMMM yyyy")).when(form == 4, F.date_format(d, "yyyy")).otherwise(F.lit("some day"))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.partial_date(written).alias("p")).select("id", "p.value", "p.precision")


@query(f"""WITH {BM25_SQL}, hit AS (SELECT doc_id FROM bm ORDER BY score DESC, doc_id LIMIT 20), w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents JOIN hit USING (doc_id)),
p AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: lower(regexp_replace(w[i], '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) IN ({", ".join(f"'{t}'" for t in TERMS)})) AS hits FROM w), s AS (SELECT doc_id, w, hits, greatest(1, coalesce(hits[1], 1) - 3) AS a FROM p)
SELECT doc_id, CASE WHEN a > 1 THEN '…' ELSE '' END || array_to_string(list_transform(range(a, least(a + 11, len(w)) + 1), lambda i: CASE WHEN list_contains(hits, i) THEN '[' || w[i] || ']' ELSE w[i] END), ' ') || CASE WHEN a + 11 < len(w) THEN '…' ELSE '' END AS snippet FROM s""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve words around the first hit of each of the best documents, hits in brackets."""
    hits = S.top(S.bm25_stored(S.stored_index(_docs(spark, sf_dir)), TERMS), 20)
    texts = _docs(spark, sf_dir).join(F.broadcast(hits.select("doc_id")), "doc_id")  # twenty rows
    return texts.select("doc_id", W.snippet(F.col("text"), TERMS, 12, 3).alias("snippet"))


@query(f"""WITH {BM25_SQL}, a AS (SELECT doc_id, score FROM bm WHERE doc_id % 2 = 0 ORDER BY score DESC, doc_id LIMIT 30), b AS (SELECT doc_id, score * 0.9 AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 30) SELECT doc_id, round(max(score), 5) AS score FROM (FROM a UNION ALL FROM b) GROUP BY doc_id ORDER BY max(score) DESC, doc_id LIMIT 25""")
def search_merged_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of several senses of a query as one, each document by its best score."""
    ranked = S.bm25_stored(S.stored_index(_docs(spark, sf_dir)), TERMS).select("doc_id", "score")
    lists = [S.top(ranked.filter("doc_id % 2 = 0"), 30), S.top(ranked, 30).select("doc_id", (F.col("score") * 0.9).alias("score"))]
    return W.best_of(lists, "doc_id", 25).select("doc_id", F.round("score", 5).alias("score"))


_ACRONYM_SQL = "acr AS (SELECT lower(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS acronym, p_name AS phrase, count(*) AS docs FROM part GROUP BY ALL)"


@query(f"WITH {_ACRONYM_SQL} SELECT acronym, phrase, docs FROM acr QUALIFY row_number() OVER (PARTITION BY acronym ORDER BY docs DESC, phrase) <= 2")
def search_acronym_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an acronym stands for: the two phrases that most texts define it as."""
    name = F.col("p_name")
    short = F.lower(F.concat(F.substring(name, 1, 1), F.substring(F.split_part(name, F.lit(" "), F.lit(2)), 1, 1)))
    counts = table(spark, sf_dir, "part").groupBy(short.alias("acronym"), name.alias("phrase")).agg(F.count("*").alias("docs"))
    return K.capped(counts, "acronym", [F.desc("docs"), F.asc("phrase")], 2)


@query("SELECT lower(p_name) AS term, p_brand AS known_as FROM (SELECT p_name, p_brand, row_number() OVER (PARTITION BY lower(p_name) ORDER BY n DESC, p_brand) AS r FROM (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY p_name, p_brand)) WHERE r <= 2")
def search_known_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the things a term is a label of are known by, two at most."""
    counts = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("term"), F.col("p_brand").alias("known_as")).agg(F.count("*").alias("n"))
    return K.capped(counts, "term", [F.desc("n"), F.asc("known_as")], 2).select("term", "known_as")


@query(f"""WITH df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term), q AS (SELECT item_id, unnest(list_distinct({TOKENS_SQL})) AS term FROM benchmark)
SELECT item_id, array_to_string(list_sort(list(term)), ' ') AS rare FROM q JOIN df USING (term) WHERE df < 50 AND (len(term) <= 5 OR regexp_matches(term, '[0-9]')) GROUP BY item_id""")
def search_rare_and_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each question the rare terms that look like acronyms; together they make a list of their own."""
    postings, _ = S.stored_index(_docs(spark, sf_dir))
    df = S.document_frequency(postings).filter("df < 50").filter((F.length("term") <= 5) | F.col("term").rlike("[0-9]"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return asked.join(df, "term").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("rare"))


_CHUNK_BM_SQL = f"""toks AS (SELECT doc_id, seq, {TOKENS_SQL} AS t FROM {WINDOWS_SQL}), stats AS (SELECT count(*) AS n, avg(len(t)) AS av FROM toks),
tf AS (SELECT doc_id, seq, term, len(t) AS dl, len(list_filter(t, lambda x: x = term))::BIGINT AS tf FROM toks, (SELECT unnest([{", ".join(f"'{t}'" for t in TERMS)}]) AS term)), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, seq, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY doc_id, seq)"""


@query(f"WITH {_CHUNK_BM_SQL} SELECT doc_id, seq, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, doc_id, seq LIMIT 20")
def search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages by BM25 over passages."""
    return W.passage_bm25(_docs(spark, sf_dir), TERMS).orderBy(F.desc("score"), "doc_id", "seq").limit(20).select("doc_id", "seq", F.round("score", 5).alias("score"))


@query(f"WITH {_CHUNK_BM_SQL}, r AS (SELECT doc_id, seq, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) AS r FROM bm) SELECT doc_id, seq, round(score, 5) AS score FROM r WHERE r = 1 ORDER BY r.score DESC, doc_id LIMIT 20")
def search_passage_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents by their best passage."""
    best = K.capped(W.passage_bm25(_docs(spark, sf_dir), TERMS), "doc_id", [F.desc("score"), F.asc("seq")], 1)
    return best.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "seq", F.round("score", 5).alias("score"))


@query("""WITH e AS (SELECT *, user_id % 2 + CASE WHEN value > 20 THEN 2 ELSE 0 END AS country FROM events), g AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 86400 OR country <> lag(country) OVER w, true) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(event_id) AS first, count(*) AS n FROM s GROUP BY user_id, k HAVING count(*) >= 8""")
def session_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of eight or more that a day's gap or another country parts."""
    rows = table(spark, sf_dir, "events").withColumn("country", F.col("user_id") % 2 + F.when(F.col("value") > 20, 2).otherwise(0))
    return W.grouped(rows, 86_400, ["country"]).groupBy("user_id", "group").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).filter("n >= 8").drop("group")


@query("""WITH g AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 86400, true) AS new, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 10800, true) AS burst FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new::INT) OVER r AS k, sum(burst::INT) OVER r AS b FROM g WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, k AS session, count(DISTINCT b) AS bursts FROM s GROUP BY user_id, k""")
def session_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts within sessions: runs with gaps under three hours."""
    outer = W.grouped(table(spark, sf_dir, "events"), 86_400, []).withColumnRenamed("group", "session")
    return W.grouped(outer, 10_800, []).groupBy("user_id", "session").agg(F.count_distinct("group").alias("bursts"))


@query("""WITH o AS (SELECT c_nationkey AS old, c_custkey AS m, c_nationkey % 3 AS verdict FROM customer), n AS (SELECT c_custkey % 40 + CASE WHEN c_acctbal > 0 THEN c_nationkey * 100 ELSE 0 END AS new, c_custkey AS m FROM customer), b AS (SELECT new, old, any_value(verdict) AS verdict, count(*) AS c FROM n JOIN o USING (m) GROUP BY new, old), s AS (SELECT new, count(*) AS k FROM n GROUP BY new)
SELECT new, old, verdict FROM b JOIN s USING (new) WHERE 2 * c > k""")
def session_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New groups keep the decision of the old one that more than half of their members come from."""
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_nationkey").alias("old"), F.col("c_custkey").alias("member"), (F.col("c_nationkey") % 3).alias("verdict"))
    new = c.select((F.col("c_custkey") % 40 + F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") * 100).otherwise(0)).alias("new"), F.col("c_custkey").alias("member"))
    return W.carried(old, new)


@query("""WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place, n_chars % 50 AS work FROM documents QUALIFY place <= 100), f AS (SELECT *, max(doc_id) OVER (PARTITION BY work) AS latest FROM w)
SELECT latest AS doc_id, min(place) AS place, coalesce(array_to_string(list_sort(list(doc_id) FILTER (doc_id <> latest)), ' '), '') AS older FROM f GROUP BY latest""")
def search_fold_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that are versions of one work as one hit, the latest, at the best place, with the older ones named."""
    hits = S.places(_docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("score"), (F.col("n_chars") % 50).alias("work")), 100)
    return W.fold_versions(hits).select("doc_id", F.col("place").cast("long").alias("place"), "older")


_LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nr FROM documents)"


@query(f"WITH {_LINES_SQL} SELECT doc_id, nr FROM (SELECT doc_id, nr, line || CASE nr % 3 WHEN 1 THEN ' .... 12' WHEN 2 THEN ', 4, 15' ELSE '' END AS line FROM l) WHERE regexp_matches(line, '[.…]{{3,}} *[0-9]+$') OR regexp_matches(line, '^[0-9]+([.][0-9]+)* .*[^0-9][0-9]{{1,3}}$') OR regexp_matches(line, '^[^,]+(, [0-9]+)+$')")
def text_contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table of contents or an index."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("nr", "line"))
    line = F.concat("line", F.when(F.col("nr") % 3 == 1, " .... 12").when(F.col("nr") % 3 == 2, ", 4, 15").otherwise(""))
    return lines.filter(W.contents_line(line)).select("doc_id", F.col("nr").cast("long").alias("nr"))


@query(f"WITH {_LINES_SQL}, c AS (SELECT doc_id, nr, line, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY nr) - len(line) - 1 AS start FROM l) SELECT doc_id, start // 600 AS part, count(*) AS lines, min(nr) AS first FROM c GROUP BY ALL")
def text_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines in windows of about 600 characters: a line belongs where it begins."""
    return W.line_windows(_docs(spark, sf_dir), 600).groupBy("doc_id", "part").agg(F.count("*").alias("lines"), F.min("nr").cast("long").alias("first"))


@query(r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]')) AS s FROM documents) SELECT doc_id, count(*) AS n FROM s WHERE regexp_matches(s, '\b(1[0-9]{3}|20[0-9]{2})\b') AND len(trim(s)) >= 30 AND NOT regexp_matches(s, '\[[0-9]+\]') GROUP BY doc_id""")
def text_dated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that name a year and are no citation."""
    return W.dated_sentences(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, regexp_matches(regexp_extract(lower(text), '\bnot((?: [a-z]+){0,3}) the\b'), 'not') AS negated FROM documents WHERE contains(lower(text), ' the ')""")
def text_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a word ever named within three words after a negation?"""
    rows = _docs(spark, sf_dir).filter(F.contains(F.lower("text"), F.lit(" the ")))
    return rows.select("doc_id", W.negated(F.col("text"), "the", ["not"], 3).alias("negated"))
