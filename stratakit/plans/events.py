"""Sessions, ledgers, windows, places, votes and calibration over ``events``, ``embeddings`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.operators import search
from stratakit.operators import sessions as S
from stratakit.plans.base import query, table
from stratakit.streaming import events as E


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_GAPS = """g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {gap} * 1000000, true){cut} AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)"""


@query(f"WITH {_GAPS.format(gap='43200::BIGINT', cut='')} SELECT user_id, session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM s GROUP BY user_id, session HAVING count(*) >= 2")
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.gap_sessions(_events(spark, sf_dir), "user_id", "ts", "event_id", 43_200, keep=2)
    return out.select("user_id", "session", _text("first").alias("first"), _text("last").alias("last"), "n")


@query(f"WITH {_GAPS.format(gap='86400::BIGINT', cut=chr(39).join([' OR event_type = ', 'signup', ''])).replace('events WINDOW', 'events WINDOW')} SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id")
def session_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups stand for cuts that a person made."""
    out = S.gap_sessions(_events(spark, sf_dir), "user_id", "ts", "event_id", 86_400, F.col("event_type") == "signup")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 6)::DOUBLE AS share FROM c QUALIFY n / sum(n) OVER (PARTITION BY user_id) >= 0.3")
def session_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dominant_value(_events(spark, sf_dir), ["user_id"], "event_type", 0.3).withColumn("share", F.round("share", 6))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.tumbling(_stamped(spark, sf_dir), "ts", "1 day")
    return out.select(_text("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(b - to_hours(12 * i::BIGINT), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS b, unnest([0, 1]) AS i FROM events) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding(_stamped(spark, sf_dir), "ts", "24 hours", "12 hours").select(_text("start").alias("start"), "n")


@query("""WITH g AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(_stamped(spark, sf_dir), "ts", "user_id", "6 hours").select("user_id", _text("start").alias("start"), "n")


@query("SELECT user_id % 7 AS step, count(*) AS calls, round(sum(value), 4) AS usd FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def ledger_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).filter("event_type = 'purchase'").withColumn("step", F.col("user_id") % 7)
    return E.spend(rows, "step", "value").withColumn("usd", F.round("usd", 4))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 4) AS usd, sum(value) >= 500 AS blocked FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def ledger_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).filter("event_type = 'purchase'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("usd"))
    return days.select("day", F.round("usd", 4).alias("usd"), (F.col("usd") >= 500).alias("blocked"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-10' GROUP BY user_id")
def ledger_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).filter("event_type IN ('view', 'click') AND ts >= TIMESTAMP_NTZ '2024-01-10'")
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("view"), F.count_if(F.col("event_type") == "click").alias("click"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY) AS stale FROM events GROUP BY event_type")
def ledger_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    last = rows.agg(F.max("ts").alias("_last"))
    return rows.join(F.broadcast(last)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("_last") - F.expr("INTERVAL 10 DAY")).alias("stale"))  # one row


_POINTS = "p AS (SELECT event_id AS id, (event_id * 37 % 1700) / 10.0 - 85 AS lat, (event_id * 91 % 3600) / 10.0 - 180 AS lon FROM events), t AS (SELECT p_partkey AS town, (p_partkey * 53 % 1700) / 10.0 - 85 AS lat, (p_partkey * 17 % 3600) / 10.0 - 180 AS lon FROM part)"


@query(f"""WITH {_POINTS}, d AS (SELECT id, town, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2)))) AS km FROM p, t)
SELECT id, round(km, 4)::DOUBLE AS km FROM d WHERE km <= 120 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, town) = 1""")
def geo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lambda rows, key, name, a, b: rows.select(F.col(key).alias(name), ((F.col(key) * a % 1700) / 10.0 - 85).alias("lat"), ((F.col(key) * b % 3600) / 10.0 - 180).alias("lon"))
    points = grid(_events(spark, sf_dir), "event_id", "id", 37, 91)
    return S.nearest(points, grid(table(spark, sf_dir, "part"), "p_partkey", "town", 53, 17), 120.0).select("id", F.round("km", 4).alias("km"))


_P = "p AS (SELECT l.doc_id, quality AS y, (n_chars % 1000) / 1000.0::DOUBLE AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select("doc_id", F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("p"))


@query(f"WITH {_P} SELECT count(*) AS n, round(avg(pow(p - y, 2)), 8) AS brier FROM p")
def stats_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.brier(_scored(spark, sf_dir)).withColumn("brier", F.round("brier", 8))


@query(f"WITH {_P} SELECT least(floor(p * 10)::BIGINT, 9) AS bin, count(*) AS n, round(avg(p), 6) AS said, round(avg(y), 6) AS happened FROM p GROUP BY ALL")
def stats_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reliability(_scored(spark, sf_dir)).select("bin", "n", F.round("said", 6).alias("said"), F.round("happened", 6).alias("happened"))


@query(f"WITH {_P}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS said, avg(y) AS happened FROM p GROUP BY ALL) SELECT round(sum(n * abs(said - happened)) / sum(n), 8) AS ece FROM b")
def stats_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.calibration_error(_scored(spark, sf_dir)).select(F.round("ece", 8).alias("ece"))


@query()
def stats_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = S.platt(_scored(spark, sf_dir))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "slope double, intercept double")


@query()
def stats_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.isotonic(_scored(spark, sf_dir))


_SIM = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, b.label, {_SIM} AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 7),
v AS (SELECT query, label, count(*) AS votes, max(sim) AS similarity FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, similarity DESC, label) AS rn FROM v)
SELECT query, label, votes, round(similarity, 5) AS similarity, round(coalesce(similarity - (SELECT max(similarity) FROM r o WHERE o.query = r.query AND rn > 1), 1), 5) AS margin FROM r WHERE rn = 1""")
def vote_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the seven nearest labelled vectors for every hundredth vector, which are asked about and so not labelled."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    near = search.knn(vectors.filter("vec_id % 100 <> 0"), asked, 7)
    known = near.join(vectors.select("vec_id", "label"), "vec_id").select("query", F.col("vec_id").alias("id"), "label", "similarity")
    out = S.neighbour_votes(asked.select("query"), known, 7)
    return out.select("query", "label", "votes", F.round("similarity", 5).alias("similarity"), F.round("margin", 5).alias("margin"))
