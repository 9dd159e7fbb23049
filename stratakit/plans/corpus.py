"""Text processing and duplicates over ``documents``, ``pages``, ``benchmark`` and ``conversations``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.operators import dedupe as U
from stratakit.operators import documents as D
from stratakit.plans.base import query, table
from stratakit.plans.retrieval import TOKENS_SQL, WINDOWS_SQL


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_LANGS = list(T.COMMON_WORDS)
_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN ({_list(T.COMMON_WORDS[c])}))) AS {c}" for c in _LANGS)
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _among(words: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(words)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 4000)), '[\p{{L}}]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, {_COUNTS} FROM w),
u AS (SELECT doc_id, n, l, v FROM c UNPIVOT (v FOR l IN ({", ".join(_LANGS)}))),
r AS (SELECT doc_id, n, max(v) AS best, arg_max(l, v) AS lang, list_sort(list(v), 'DESC')[2] AS second FROM u GROUP BY doc_id, n)
SELECT doc_id, CASE WHEN n >= 20 AND best >= greatest(3, 0.02 * n) AND best >= 1.25 * second THEN lang END AS detected FROM r""")
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by common words in the first 4,000 characters: the leader needs 3 hits, 2 % of words, and 1.25 times the next."""
    words = F.regexp_extract_all(F.lower(F.substring("text", 1, 4000)), F.lit(r"([\p{L}]+)"), F.lit(1))
    rows = _docs(spark, sf_dir).select("doc_id", words.alias("w"))
    hits = F.array(*[F.struct(F.size(F.filter("w", _among(T.COMMON_WORDS[c]))).alias("v"), F.lit(c).alias("l")) for c in _LANGS])
    rows = rows.select("doc_id", F.size("w").alias("n"), F.reverse(F.array_sort(hits)).alias("h"))
    best, second = F.col("h")[0], F.col("h")[1]
    sure = (F.col("n") >= 20) & (best["v"] >= F.greatest(F.lit(3.0), 0.02 * F.col("n"))) & (best["v"] >= 1.25 * second["v"])
    return rows.select("doc_id", F.when(sure, best["l"]).alias("detected"))


@query(r"""WITH p AS (SELECT page_id, trim(url) AS u FROM pages),
s AS (SELECT page_id, lower(regexp_extract(regexp_replace(u, '#.*$', ''), '^([^:/?#]+://[^/?]*)', 1)) AS head, regexp_replace(regexp_replace(u, '#.*$', ''), '^[^:/?#]+://[^/?]*', '') AS rest FROM p),
q AS (SELECT page_id, head, regexp_extract(rest, '^([^?]*)', 1) AS path, array_to_string(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
  lambda x: x <> '' AND NOT regexp_matches(regexp_extract(x, '^([^=]*)', 1), '@TRACKING', 'i')), '&') AS params FROM s)
SELECT page_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS canonical FROM q""".replace("@TRACKING", T.TRACKING.replace("(?i)", "")))
def page_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query(r"""SELECT page_id, nullif(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '') AS title FROM pages""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS n_links, list_distinct(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) = [] AS none FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), (F.size(F.array_distinct(links)) == 0).alias("none"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n, count(*) FILTER (regexp_matches(url, '[?&](utm_\\w+|ref)=')) AS tracked FROM pages GROUP BY ALL")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").rlike(r"[?&](utm_\w+|ref)=")).alias("tracked"))


@query(r"SELECT page_id FROM pages WHERE strlen(html) <= 32768 AND regexp_matches(lower(html), '(checking your browser|enable javascript and cookies|captcha|are you a robot)')")
def page_bot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = F.lower("html").rlike("(checking your browser|enable javascript and cookies|captcha|are you a robot)")
    return table(spark, sf_dir, "pages").filter((F.octet_length("html") <= 32768) & cue).select("page_id")


@query(r"SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS mails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def text_mail_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1))
    return _docs(spark, sf_dir).select("doc_id", mails.alias("mails")).filter(F.size("mails") > 0)


@query(r"""WITH c AS (SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')::INT + regexp_matches(text, '\+?\d[\d ()-]{8,}\d')::INT + regexp_matches(text, '\b(\d{1,3}\.){3}\d{1,3}\b')::INT AS weak,
regexp_matches(text, '(?i)(api[_-]?key|secret|password)\s*[=:]') AS strong FROM documents) SELECT doc_id, weak::BIGINT AS weak, strong FROM c WHERE strong OR weak >= 2""")
def text_personal_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspected personal texts: one strong cue, or two weak ones."""
    weak = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+?\d[\d ()-]{8,}\d", r"\b(\d{1,3}\.){3}\d{1,3}\b"]
    count = sum((F.col("text").rlike(p).cast("long") for p in weak), F.lit(0))
    rows = _docs(spark, sf_dir).select("doc_id", count.cast("long").alias("weak"), F.col("text").rlike(r"(?i)(api[_-]?key|secret|password)\s*[=:]").alias("strong"))
    return rows.filter("strong OR weak >= 2")


@query(f"SELECT doc_id, count(*) AS n FROM {_LINES} WHERE regexp_matches(lower(line), '(license|licence|copyright|all rights reserved)') GROUP BY doc_id")
def text_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(_docs(spark, sf_dir)).filter(F.lower("line").rlike("(license|licence|copyright|all rights reserved)")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"SELECT md5(line) AS line, count(DISTINCT doc_id) AS docs, count(*) AS n FROM {_LINES} WHERE len(line) >= 20 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3")
def text_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(_docs(spark, sf_dir)).filter(F.length("line") >= 20)
    by_doc = rows.groupBy("line", "doc_id").agg(F.count("*").alias("n"))  # a common line is counted by document first
    return by_doc.groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("docs"), F.sum("n").alias("n")).filter("docs >= 3")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[\d.,%/+-]+')) AS real FROM documents WHERE NOT contains(text, '$') AND NOT contains(text, '='))
SELECT doc_id, round(len(list_filter(real, lambda x: regexp_full_match(x, '\p{L}{1,24}[.,;:!?]*'))) / len(real), 6) AS wordlike FROM t WHERE len(real) >= 4""")
def text_noise_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tokens that look like words, numbers apart; texts with maths or code signs are left alone."""
    real = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: (x != "") & ~x.rlike(r"^[\d.,%/+-]+$"))
    rows = _docs(spark, sf_dir).filter(~F.col("text").contains("$") & ~F.col("text").contains("=")).select("doc_id", real.alias("r")).filter(F.size("r") >= 4)
    return rows.select("doc_id", F.round(F.size(F.filter("r", lambda x: x.rlike(r"^\p{L}{1,24}[.,;:!?]*$"))) / F.size("r"), 6).alias("wordlike"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(substr(text, 1, 40)), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM documents")
def text_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring("text", 1, 40)
    return _docs(spark, sf_dir).select("doc_id", T.slug(head).alias("slug"), T.normal_title(head).alias("title"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[=+*/<>^]')) AS signs, round(10000.0 * len(regexp_extract_all(text, '[=+*/<>^]')) / len(text), 4)::DOUBLE AS density FROM documents WHERE len(text) > 0")
def text_equation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = F.size(F.regexp_extract_all("text", F.lit("([=+*/<>^])"), F.lit(1)))
    return _docs(spark, sf_dir).filter(F.length("text") > 0).select("doc_id", signs.cast("long").alias("signs"), F.round(10000.0 * signs / F.length("text"), 4).alias("density"))


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.exact_groups(_docs(spark, sf_dir), "text")


@query("SELECT arg_min(doc_id, doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY source, substr(text, 1, 30)")
def dup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.substring("text", 1, 30).alias("head"))
    kept = U.keep_first(rows, ["source", "head"], [F.asc("doc_id")])
    return kept.join(rows.groupBy("source", "head").agg(F.count("*").alias("n")), ["source", "head"]).select("doc_id", "n")


_SHINGLES_SQL = f"""w AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) AS i FROM w) WHERE len(t) > 0)"""
_PASSAGES_SQL = rf"s AS (SELECT DISTINCT doc_id, sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS g FROM {WINDOWS_SQL})"
_CLASSES_SQL = """k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id, n FROM k)"""
_PAIRS_SQL = """f AS (SELECT s.doc_id, g, n FROM s JOIN c USING (doc_id) WHERE doc_id = class_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS j FROM f x JOIN f y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL)"""


def _passage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each document as hashes of their text with white space folded."""
    hashed = F.xxhash64(F.trim(F.regexp_replace("text", r"\s+", " ")))
    return D.chunks(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_set(hashed)).alias("s"))


def _shingle_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", U.shingle_hashes(F.col("text")).alias("s"))


@query(f"WITH {_SHINGLES_SQL}, {_CLASSES_SQL}, {_PAIRS_SQL} SELECT a, b, round(j, 6) AS jaccard FROM p WHERE j >= 0.1")
def dup_shingle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal shingle sets, each named by its least document."""
    return U.class_pairs(_shingle_sets(spark, sf_dir), "doc_id", "s", 0.1).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {_SHINGLES_SQL}, {_CLASSES_SQL} SELECT doc_id, class_id FROM c")
def dup_shingle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document with a shingle: members of the pairs' classes."""
    return U.set_classes(_shingle_sets(spark, sf_dir), "doc_id", "s").select("doc_id", F.col("class").alias("class_id"))


@query(f"WITH {_PASSAGES_SQL}, {_CLASSES_SQL}, {_PAIRS_SQL} SELECT a, b, round(j, 6) AS jaccard FROM p WHERE j >= 0.9")
def dup_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of passage hashes are alike to 0.9."""
    return U.class_pairs(_passage_sets(spark, sf_dir), "doc_id", "s", 0.9).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {_PASSAGES_SQL}, {_CLASSES_SQL} SELECT doc_id, class_id FROM c")
def dup_chunk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.set_classes(_passage_sets(spark, sf_dir), "doc_id", "s").select("doc_id", F.col("class").alias("class_id"))


@query(f"""WITH w AS (SELECT doc_id, substr(text, 1, 14) AS title, {TOKENS_SQL} AS t FROM documents),
k AS (SELECT doc_id, t, CASE WHEN len(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 9 THEN regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') END AS k FROM w),
g AS (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k HAVING count(*) BETWEEN 2 AND 6),
s AS (SELECT doc_id, k, list_distinct(list_transform(range(1, greatest(1, len(t) - 4) + 1), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM k JOIN g USING (k)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.s, y.s)) AS n_both, len(x.s) AS na, len(y.s) AS nb FROM s x JOIN s y USING (k) WHERE x.doc_id < y.doc_id)
SELECT a, b, round(n_both / (na + nb - n_both), 6) AS overlap, CASE WHEN n_both / (na + nb - n_both) >= 0.9 THEN 'copy' ELSE 'version' END AS kind FROM p WHERE n_both / (na + nb - n_both) >= 0.1""")
def dup_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 14).alias("title"), "text")
    return U.version_groups(rows).withColumn("overlap", F.round("overlap", 6))


@query()
def dup_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal customer names by MinHash bands; a random hash has no SQL twin."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return U.near_names(names.groupBy("name").agg(F.min("id").alias("id")).select("id", "name"), 0.7)


@query(f"""WITH b AS (SELECT item_id, {TOKENS_SQL} AS t FROM benchmark), d AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
bg AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) AS i FROM b)),
dg AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) AS i FROM d)),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id)
SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS held FROM bg JOIN dg USING (g) JOIN n USING (item_id) GROUP BY item_id, doc_id HAVING count(*) / any_value(n) >= 0.5""")
def text_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each test item's word 5-grams that a document holds."""
    grams = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(U.shingles(F.col("text"))).alias("g"))
    items = grams("benchmark", "item_id")
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n"))
    held = items.join(grams("documents", "doc_id"), "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("c")).join(sizes, "item_id")
    return held.select("item_id", "doc_id", F.round(F.col("c") / F.col("n"), 6).alias("held"), (F.col("c") / F.col("n")).alias("s")).filter("s >= 0.5").drop("s")


@query("SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id")
def conv_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(lines, "\n")).alias("rendered"))


@query("""WITH r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS run FROM conversations)
SELECT conv_id, role, min(turn) AS first, count(*) AS n FROM r GROUP BY conv_id, role, run HAVING count(*) >= 1""")
def conv_role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("run", run).groupBy("conv_id", "role", "run").agg(F.min("turn").alias("first"), F.count("*").alias("n")).drop("run")


@query("""WITH held AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, source || 'x' AS source, n_chars + (doc_id % 2) AS n_chars FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC, k DESC) AS r FROM (SELECT *, 0 AS k FROM held UNION ALL SELECT *, 1 FROM new)) WHERE r = 1""")
def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    new = docs.filter("doc_id % 2 = 0").select("doc_id", F.concat("source", F.lit("x")).alias("source"), (F.col("n_chars") + F.col("doc_id") % 2).alias("n_chars"))
    return D.keep_latest(docs.filter("doc_id % 3 <> 0"), new, ["doc_id"], "n_chars")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def doc_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("stamp"))
    return D.behind(_docs(spark, sf_dir).select("doc_id"), stamps, ["doc_id"], "1")


@query("""WITH p AS (SELECT md5(text) AS sha256, 'a/' || doc_id AS path, n_chars AS size, doc_id FROM documents) SELECT sha256, min(path) AS path, max(size) AS size FROM p GROUP BY sha256 HAVING count(*) = 1 AND min(doc_id) % 5 <> 0""")
def doc_single_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.md5("text").alias("sha256"), F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("gone"), "doc_id")
    firsts = rows.groupBy("sha256").agg(F.min("doc_id").alias("d")).filter("d % 5 = 0").select(F.col("sha256").alias("hash"))
    return D.single_copies(rows, firsts)


@query("SELECT md5(text) AS sha256, count(*) AS copies, max(n_chars) AS size, max(n_chars) * (count(*) - 1) AS wasted FROM documents GROUP BY text HAVING count(*) > 1")
def doc_duplicate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.md5("text").alias("sha256"), F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("gone"))
    return D.duplicate_places(rows)


@query("""WITH RECURSIVE r AS (SELECT doc_id, (doc_id * 7 + 3) % (doc_id + 1) AS nxt FROM documents WHERE doc_id % 4 <> 0),
w AS (SELECT doc_id, nxt AS cur FROM r UNION ALL SELECT w.doc_id, r.nxt FROM w JOIN r ON w.cur = r.doc_id WHERE r.nxt <> r.doc_id)
SELECT doc_id, min(cur) AS current FROM w GROUP BY doc_id""")
def doc_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects always point down here, so the end of a chain is its least id."""
    redirects = _docs(spark, sf_dir).filter("doc_id % 4 <> 0").select("doc_id", ((F.col("doc_id") * 7 + 3) % (F.col("doc_id") + 1)).alias("replaced_by"))
    return D.current_of(redirects)
