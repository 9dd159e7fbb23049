"""Relational operators over the star schema, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.plans.base import query, table


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def rel_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


@query("""SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, strftime(o_orderdate, '%Y-%m-%d') AS day
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def rel_shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return joined.groupBy("o_orderkey", "o_orderdate").agg(revenue).select("o_orderkey", "revenue", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey GROUP BY n_name""")
def rel_local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    nations = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = nations.join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
    lines = orders.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = lines.join(t("supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return out.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def rel_forecast_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return lines.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def rel_left_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))  # aggregated before the join
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT count(*) AS n FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < 0 AND s_acctbal < 0")
def rel_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_acctbal") < 0) & (F.col("s_acctbal") < 0)
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), on, "full").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand HAVING count(DISTINCT l_suppkey) > 5")
def rel_distinct_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("p_brand").agg(F.count_distinct("l_suppkey").alias("suppliers")).filter("suppliers > 5")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_filled, round(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END), 0)::BIGINT AS n_dear FROM orders GROUP BY ALL")
def rel_filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.count_if(F.expr(c))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(count("o_orderstatus = 'O'").alias("n_open"), count("o_orderstatus = 'F'").alias("n_filled"), count("o_totalprice > 100000").alias("n_dear"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY ALL")
def rel_string_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"))


@query("SELECT c_nationkey, c_mktsegment, grouping_id(c_nationkey, c_mktsegment)::BIGINT AS level, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, NULL AS o_orderpriority, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT NULL, o_orderpriority, count(*) FROM orders GROUP BY ALL")
def rel_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, rn, round(running, 2) AS running, prev FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, sum(o_totalprice) OVER w AS running, lag(o_orderkey) OVER w AS prev
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE rn <= 3""")
def rel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.round(F.sum("o_totalprice").over(upto), 2).alias("running"), F.lag("o_orderkey").over(w).alias("prev"))
    return out.filter("rn <= 3")


@query("SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM lineitem")
def rel_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(-2, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.avg("l_extendedprice").over(w), 4).alias("moving"))


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 2")
def rel_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, sf_dir, "supplier").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("s_nationkey", "s_suppkey", "s_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def rel_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(20)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def rel_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def rel_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def rel_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_partkey"))


@query("""SELECT event_id, o.o_orderkey FROM events ASOF JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderdate + INTERVAL 20 YEAR AS at FROM orders GROUP BY o_custkey, o_orderdate) o ON user_id = o_custkey AND ts >= o.at""")
def rel_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order (dates moved to the events' years) at or before each event: one sorted pass over both, no range join."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    left = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    right = orders.select(F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 20 YEAR")).alias("at"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("k").orderBy("at", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w))
    return found.filter("event_id IS NOT NULL AND o_orderkey IS NOT NULL").select("event_id", "o_orderkey")


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_acctbal BETWEEN p_retailprice - 20 AND p_retailprice + 20""")
def rel_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band join through buckets as wide as the band: each row meets the buckets around it. Parts of a bucket are dealt among ``deals``, each with its suppliers, so that tasks share the pairs."""
    width, deals, n = 40.0, 32, int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.explode(F.sequence(F.floor((F.col("p_retailprice") - 20) / width), F.floor((F.col("p_retailprice") + 20) / width))).alias("b"))
    parts = parts.withColumn("d", F.pmod(F.xxhash64("p_partkey"), F.lit(deals)).cast("int")).repartition(n, "b", "d")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / width).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("d"))
    return parts.join(suppliers.hint("merge"), ["b", "d"]).filter(F.col("s_acctbal").between(F.col("p_retailprice") - 20, F.col("p_retailprice") + 20)).select("p_partkey", "s_suppkey")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "purchase", "view"]
    out = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return out.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


@query("SELECT (props->>'$.k')::BIGINT % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def rel_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT vec_id, i - 1 AS i, round(embedding[i]::DOUBLE, 5) AS v FROM embeddings, range(1, 65) t(i)")
def rel_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query("SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40) AS n FROM part")
def rel_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").join(many, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))
