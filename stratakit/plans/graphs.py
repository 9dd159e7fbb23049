"""Graph reads, rules and resolution over entities and edges that are derived from the star schema.

Nodes: nation n is n, region r is 1000 + r, customer c is 10000 + c, supplier s is 10_000_000 + s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.operators import density as D
from stratakit.operators import graph as G
from stratakit.operators import inference as I
from stratakit.operators import modularity as M
from stratakit.operators import search as S
from stratakit.plans.base import query, table

NODES_SQL = """
nodes AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, 'nation' AS type FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name, 'region' FROM region
  UNION ALL SELECT 10000 + c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 10000000 + s_suppkey, s_name, 'supplier' FROM supplier),
edges AS (SELECT o_orderkey AS id, 10000 + o_custkey AS src, 'buys_in' AS rel, (o_orderkey % 25)::BIGINT AS dst, CASE o_orderkey % 3 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
    CASE o_orderkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'medium' ELSE 'weak' END AS strength, (o_orderkey % 97)::BIGINT AS source_doc,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS valid_from, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%dT%H:%M:%SZ') END AS valid_to,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS world_from,
    CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate + INTERVAL 60 DAY, '%Y-%m') END AS world_to FROM orders
  UNION ALL SELECT 100000000 + s_suppkey, 10000000 + s_suppkey, 'located_in', s_nationkey, 'EXTRACTED', 'strong', s_suppkey % 97, '1990-01-01T00:00:00Z', NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 200000000 + n_nationkey, n_nationkey, 'part_of', 1000 + n_regionkey, 'EXTRACTED', 'strong', n_nationkey % 97, '1990-01-01T00:00:00Z', NULL, NULL, NULL FROM nation)"""
ENDS_SQL = "ends AS (SELECT *, src AS node, dst AS other FROM edges UNION ALL SELECT *, dst, src FROM edges), degree AS (SELECT node, count(*) AS degree, count(DISTINCT source_doc) AS docs FROM ends GROUP BY node)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, key, off, label, kind: table(spark, sf_dir, name).select((F.col(key).cast("long") + off).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("type"))
    return part("nation", "n_nationkey", 0, "n_name", "nation").unionByName(part("region", "r_regionkey", 1000, "r_name", "region")).unionByName(part("customer", "c_custkey", 10000, "c_name", "customer")).unionByName(part("supplier", "s_suppkey", 10_000_000, "s_name", "supplier"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, third = F.col("o_orderkey"), lambda *v: F.when(F.col("o_orderkey") % 3 == 0, v[0]).when(F.col("o_orderkey") % 3 == 1, v[1]).otherwise(v[2])
    stamp, date = "yyyy-MM-dd'T'HH:mm:ss'Z'", F.col("o_orderdate")
    null = F.lit(None).cast("string")
    orders = table(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") + 10000).alias("src"), F.lit("buys_in").alias("rel"), (k % 25).cast("long").alias("dst"), third("EXTRACTED", "INFERRED", "AMBIGUOUS").alias("confidence"), third("strong", "medium", "weak").alias("strength"), (k % 97).cast("long").alias("source_doc"),
        F.date_format(date, stamp).alias("valid_from"), F.when(k % 5 == 0, F.date_format(date + F.expr("INTERVAL 365 DAY"), stamp)).alias("valid_to"),
        F.when(k % 4 == 0, F.date_format(date, "yyyy")).when(k % 4 == 1, F.date_format(date, "yyyy-MM")).when(k % 4 == 2, F.date_format(date, "yyyy-MM-dd")).alias("world_from"),
        F.when(k % 7 == 0, F.date_format(date + F.expr("INTERVAL 60 DAY"), "yyyy-MM")).alias("world_to"),
    )

    def fixed(name: str, key: str, first: int, off: int, rel: str, dst: Column) -> DataFrame:
        key_of = F.col(key).cast("long")
        return table(spark, sf_dir, name).select((key_of + first).alias("id"), (key_of + off).alias("src"), F.lit(rel).alias("rel"), dst.cast("long").alias("dst"), F.lit("EXTRACTED").alias("confidence"), F.lit("strong").alias("strength"), (key_of % 97).alias("source_doc"), F.lit("1990-01-01T00:00:00Z").alias("valid_from"), null.alias("valid_to"), null.alias("world_from"), null.alias("world_to"))

    suppliers = fixed("supplier", "s_suppkey", 100_000_000, 10_000_000, "located_in", F.col("s_nationkey"))
    return orders.unionByName(suppliers).unionByName(fixed("nation", "n_nationkey", 200_000_000, 0, "part_of", F.col("n_regionkey") + 1000))


@query(f"WITH {NODES_SQL}, {ENDS_SQL} SELECT node, degree, docs FROM degree")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree(edges(spark, sf_dir))


@query(f"WITH {NODES_SQL}, {ENDS_SQL} SELECT node, degree, docs FROM degree ORDER BY degree DESC, node LIMIT 15")
def graph_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hubs(edges(spark, sf_dir), 15)


@query(f"""WITH {NODES_SQL}, {ENDS_SQL}, top AS (SELECT node FROM degree ORDER BY degree DESC, node LIMIT 12), held AS (SELECT DISTINCT node, source_doc FROM ends SEMI JOIN top USING (node))
SELECT x.node AS a, y.node AS b, count(*) AS shared FROM held x JOIN held y USING (source_doc) WHERE x.node < y.node GROUP BY ALL HAVING count(*) >= 2""")
def graph_co_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return G.co_documents(e, G.hubs(e, 12), 2)


@query(f"""WITH {NODES_SQL}, near AS (SELECT *, dense_rank() OVER (PARTITION BY src, rel, dst ORDER BY source_doc) AS d, row_number() OVER (PARTITION BY src, rel, dst ORDER BY id) AS copy FROM edges WHERE src = 3 OR dst = 3),
s AS (SELECT *, max(d) OVER (PARTITION BY src, rel, dst) AS support FROM near), f AS (SELECT rel, count(*) AS facts FROM s WHERE copy = 1 GROUP BY rel),
t AS (SELECT s.*, facts, row_number() OVER (PARTITION BY rel, copy > 1 ORDER BY support DESC, id) AS turn FROM s JOIN f USING (rel))
SELECT id, src, rel, dst, support FROM t ORDER BY copy > 1, CASE WHEN copy = 1 THEN turn ELSE 0 END, CASE WHEN copy = 1 THEN -facts ELSE 0 END, rel, turn LIMIT 40""")
def graph_first_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_hop(edges(spark, sf_dir), 3, 40).withColumn("support", F.col("support").cast("long"))


@query(f"""WITH {NODES_SQL}, {ENDS_SQL}, one AS (SELECT DISTINCT other AS n1 FROM ends WHERE node = 1002), two AS (SELECT e.other, e.source_doc FROM one JOIN ends e ON e.node = n1 WHERE e.other <> 1002 AND e.other NOT IN (FROM one)),
r AS (SELECT other, type, count(DISTINCT source_doc) AS docs FROM two JOIN nodes ON other = id GROUP BY ALL)
SELECT other, docs, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY docs DESC, other) AS rn FROM r) WHERE rn <= 12 ORDER BY docs DESC, other LIMIT 40""")
def graph_second_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.second_hop(edges(spark, sf_dir), nodes(spark, sf_dir), 1002)


@query(f"WITH {NODES_SQL} SELECT rel, count(*) AS n, count(DISTINCT src) AS subjects FROM edges WHERE valid_from <= '1996-06-31T23:59:59Z' AND (valid_to IS NULL OR valid_to > '1996-06-31T23:59:59Z') GROUP BY rel")
def graph_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter(G.held_at("1996-06")).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("subjects"))


@query(f"""WITH {NODES_SQL} SELECT id FROM edges WHERE (world_from IS NULL OR left(world_from, least(len(world_from), 7)::INT) <= left('1995-03', least(len(world_from), 7)::INT)) AND (world_to IS NULL OR left(world_to, least(len(world_to), 7)::INT) >= left('1995-03', least(len(world_to), 7)::INT))""")
def graph_world_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter(G.held_in_world("1995-03")).select("id")


@query(f"""WITH {NODES_SQL}, c AS (SELECT 'added' AS kind, rel, valid_from AS at, id FROM edges WHERE valid_from BETWEEN '1996-01' AND '1996-03-31T23:59:59Z' UNION ALL SELECT 'ended', rel, valid_to, id FROM edges WHERE valid_to BETWEEN '1996-01' AND '1996-03-31T23:59:59Z')
SELECT kind, rel, count(*) AS n, max("at") AS latest FROM c GROUP BY kind, rel""")
def graph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.changes(edges(spark, sf_dir), "1996-01", "1996-03").groupBy("kind", "rel").agg(F.count("*").alias("n"), F.max("at").alias("latest"))


@query(f"""WITH {NODES_SQL}, a AS (SELECT 'added' AS kind, id FROM edges e WHERE valid_from BETWEEN '1996-01' AND '1996-12-31T23:59:59Z' AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.src = e.src AND o.rel = e.rel AND o.dst = e.dst AND o.id <> e.id AND o.valid_from < '1996-01' AND (o.valid_to IS NULL OR o.valid_to >= '1996-01'))),
b AS (SELECT 'ended' AS kind, id FROM edges e WHERE valid_to BETWEEN '1996-01' AND '1996-12-31T23:59:59Z' AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.src = e.src AND o.rel = e.rel AND o.dst = e.dst AND o.id <> e.id AND o.valid_to IS NULL)) FROM a UNION ALL FROM b""")
def graph_changes_no_rereadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.changes(edges(spark, sf_dir), "1996-01", "1996-12", rereadings=False).select("kind", "id")


@query(f"WITH {NODES_SQL} SELECT rel, confidence, count(*) AS n, count(*) FILTER (valid_to IS NULL) AS live, min(valid_from) AS first FROM edges GROUP BY ALL")
def graph_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("rel", "confidence").agg(F.count("*").alias("n"), F.count_if(F.col("valid_to").isNull()).alias("live"), F.min("valid_from").alias("first"))


FACTS_SQL = "facts AS (SELECT src, rel, dst, count(DISTINCT source_doc) AS docs, CASE min(strength) WHEN 'strong' THEN 1.0 WHEN 'medium' THEN 2.0 ELSE 3.0 END * min(CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 1.35 ELSE 2.0 END)::DOUBLE / (1 + log2(greatest(1, count(DISTINCT source_doc)))) AS cost FROM edges GROUP BY ALL)"


@query(f"WITH {NODES_SQL}, {FACTS_SQL} SELECT src, rel, dst, docs, round(cost, 6)::DOUBLE AS cost FROM facts")
def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.facts(edges(spark, sf_dir)).select("src", "rel", "dst", "docs", F.round("cost", 6).alias("cost"))


@query(f"""WITH {NODES_SQL}, {FACTS_SQL}, d AS (SELECT * FROM facts WHERE rel <> 'buys_in' OR docs >= 2), two AS (SELECT src, dst, cost FROM d UNION ALL SELECT dst, src, cost FROM d),
step AS (SELECT src, dst, min(cost) AS cost FROM two GROUP BY ALL), deg AS (SELECT src AS n, count(*) AS k FROM two GROUP BY src HAVING count(*) <= 1500),
p AS (SELECT [src, dst] AS path, cost FROM step WHERE src = 1 AND dst = 2 UNION ALL
  SELECT [a.src, a.dst, b.dst], a.cost + b.cost + 0.5 * ln(1 + x.k) FROM step a JOIN step b ON a.dst = b.src JOIN deg x ON x.n = a.dst WHERE a.src = 1 AND b.dst = 2 AND a.dst NOT IN (1, 2) UNION ALL
  SELECT [a.src, a.dst, b.dst, c.dst], a.cost + b.cost + c.cost + 0.5 * ln(1 + x.k) + 0.5 * ln(1 + y.k) FROM step a JOIN step b ON a.dst = b.src JOIN step c ON b.dst = c.src JOIN deg x ON x.n = a.dst JOIN deg y ON y.n = b.dst
    WHERE a.src = 1 AND c.dst = 2 AND a.dst NOT IN (1, 2) AND b.dst NOT IN (1, 2) AND a.dst <> b.dst),
best AS (SELECT *, row_number() OVER (PARTITION BY list_sort(path[2:-2]) ORDER BY cost, array_to_string(path, ',')) AS r FROM p)
SELECT array_to_string(path, '>') AS path, round(cost, 6)::DOUBLE AS cost FROM best WHERE r = 1 ORDER BY best.cost, array_to_string(best.path, ',') LIMIT 3""")
def graph_cheapest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = G.facts(edges(spark, sf_dir)).filter("rel <> 'buys_in' OR docs >= 2")
    return G.cheapest_paths(known, 1, 2).select(F.array_join("path", ">").alias("path"), F.round("cost", 6).alias("cost"))


@query(f"""WITH {NODES_SQL}, {ENDS_SQL}, f AS (SELECT id FROM nodes WHERE name = 'CANADA' UNION SELECT id FROM nodes WHERE lower(name) = 'canada') SELECT f.id, type, degree AS edges, docs FROM f JOIN nodes USING (id) JOIN degree ON node = f.id""")
def graph_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return G.senses(n, n.select(F.col("id").alias("entity_id"), F.col("name").alias("label")), edges(spark, sf_dir), "CANADA")


@query(f"""WITH {NODES_SQL}, o(rel, dom, ran) AS (VALUES ('buys_in', ['customer'], ['nation']), ('located_in', ['agent'], ['place']), ('part_of', ['nation'], ['nation'])), up(type, ancestor) AS (VALUES ('customer', 'customer'), ('customer', 'agent'), ('supplier', 'supplier'), ('supplier', 'agent'), ('nation', 'nation'), ('nation', 'place'), ('region', 'region'), ('region', 'place'))
SELECT e.rel, EXISTS (SELECT 1 FROM up WHERE type = a.type AND list_contains(dom, ancestor)) AND EXISTS (SELECT 1 FROM up WHERE type = b.type AND list_contains(ran, ancestor)) AS fits, count(*) AS n FROM edges e JOIN o USING (rel) JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL""")
def graph_check_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = spark.createDataFrame([("buys_in", ["customer"], ["nation"]), ("located_in", ["agent"], ["place"]), ("part_of", ["nation"], ["nation"])], "rel string, domain array<string>, range array<string>")
    pairs = [(t, t) for t in ("customer", "supplier", "nation", "region")] + [("customer", "agent"), ("supplier", "agent"), ("nation", "place"), ("region", "place")]
    closure = spark.createDataFrame(pairs, "type string, ancestor string")
    return G.check_edges(edges(spark, sf_dir), nodes(spark, sf_dir).select("id", "type"), closure, relations).groupBy("rel", "fits").agg(F.count("*").alias("n"))


@query(f"WITH {NODES_SQL} SELECT id FROM edges WHERE NOT (source_doc % 10 = 3) AND NOT (id % 100 = 7 AND (id - 1) IN (SELECT id FROM edges WHERE source_doc % 10 = 3))")
def graph_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    hidden = e.select(F.col("source_doc").alias("doc_id")).distinct().filter("doc_id % 10 = 3")
    premises = e.filter("id % 100 = 7").select(F.col("id").alias("edge"), (F.col("id") - 1).alias("premise"))
    return G.visible(e, hidden, premises).select("id")


def _part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deeper tree for the rules: part p is within part p // 3."""
    return table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst"))


_PART_OF_SQL = "e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0)"


@query(f"WITH RECURSIVE {_PART_OF_SQL}, r AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON r.dst = e.src WHERE depth < 6 AND r.src <> e.dst) SELECT src, dst, min(depth)::BIGINT AS depth FROM r GROUP BY src, dst HAVING min(depth) > 1")
def rules_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.closure(_part_of(spark, sf_dir)).select("src", "dst", F.col("depth").cast("long").alias("depth"))


@query(f"WITH {_PART_OF_SQL} SELECT dst AS src, src AS dst FROM e WHERE (dst, src) NOT IN (SELECT (src, dst) FROM e)")
def rules_converse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.converse(_part_of(spark, sf_dir))


@query(f"WITH {NODES_SQL} SELECT a.src, b.dst, min(a.dst) AS middle FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel = 'located_in' AND b.rel = 'part_of' AND a.src <> b.dst GROUP BY a.src, b.dst")
def rules_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return I.chain(e.filter("rel = 'located_in'"), e.filter("rel = 'part_of'"))


@query("SELECT coalesce(p.k, h.k) AS k, CASE WHEN h.k IS NULL THEN 'add' WHEN p.k IS NULL THEN 'end' ELSE 'keep' END AS action FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000) p FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) h ON p.k = h.k")
def rules_in_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    return I.in_step(planned, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@query(f"""WITH {NODES_SQL}, b AS (SELECT src, dst, arg_min(id, (confidence <> 'EXTRACTED')::INT * 1000000000 + id) AS id FROM edges WHERE rel = 'buys_in' GROUP BY src, dst),
m AS (SELECT src, id FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY id) <= 7), p AS (SELECT x.src, x.id AS a, y.id AS b FROM m x JOIN m y USING (src) WHERE x.id < y.id)
SELECT src, a, b FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY a, b) <= 6""")
def rules_functional_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.functional_conflicts(edges(spark, sf_dir).filter("rel = 'buys_in'"))


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS a, p_partkey - (p_partkey % 10 > 0)::INT AS b FROM part), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def rules_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of ten parts."""
    return I.components(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - (F.col("p_partkey") % 10 > 0).cast("int")).alias("b")))


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS name, p_brand AS type, p_size AS degree, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM part),
s AS (SELECT id, first_value(id) OVER (PARTITION BY type, regexp_replace(k, '(\\b[\\p{L}\\p{N}]{4,})s$', '\\1') ORDER BY degree DESC, len(regexp_replace(name, '[^\\p{Lu}]', '', 'g')) DESC, len(name), id) AS target FROM e) SELECT id, target AS "into" FROM s WHERE id <> target""")
def resolve_equal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.equal_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_size").alias("degree")))


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS id, p_partkey // 4 AS target FROM part WHERE p_partkey > 0 AND p_partkey % 4 <> 1),
w AS (SELECT id, target FROM m UNION ALL SELECT w.id, m.target FROM w JOIN m ON w.target = m.id) SELECT id, min(target) AS cid FROM w GROUP BY id""")
def resolve_merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_chains(table(spark, sf_dir, "part").filter("p_partkey > 0 AND p_partkey % 4 <> 1").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 4).alias("into")))


@query("""WITH c AS (SELECT c_nationkey AS k, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, lead(n) OVER w AS nx, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY k ORDER BY n DESC, v)) SELECT k, v FROM r WHERE rn = 1 AND (nx IS NULL OR n >= 1.3 * nx)""")
def resolve_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v")).agg(F.count("*").alias("n"))
    return I.dominant(counts, "k", "v", "n", 1.3)


_CO_SQL = """r AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS entity FROM lineitem), k AS (SELECT r.* FROM r JOIN (SELECT entity FROM r GROUP BY entity HAVING count(*) >= 2) USING (entity)),
m AS (SELECT doc, count(*) AS m FROM k GROUP BY doc HAVING count(*) > 1), w AS (SELECT x.entity AS a, y.entity AS b, sum(1 / (m - 1)) AS weight FROM k x JOIN k y USING (doc) JOIN m USING (doc) WHERE x.entity < y.entity GROUP BY ALL)"""


def _co(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.co_occurrence(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("entity")))


@query(f"WITH {_CO_SQL} SELECT a, b, round(weight, 6) AS weight FROM w")
def community_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _co(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query()
def community_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of communities by modularity of suppliers that share orders."""
    return M.two_levels(_co(spark, sf_dir))


@query(f"WITH {_CO_SQL} SELECT least(a % 7, b % 7) AS a, greatest(a % 7, b % 7) AS b, count(*) AS links, round(sum(weight), 5) AS weight FROM w WHERE a % 7 <> b % 7 GROUP BY ALL")
def community_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 7).alias("region"))
    return I.region_crossings(_co(spark, sf_dir), placed).withColumn("weight", F.round("weight", 5))


@query("""WITH o AS (SELECT c_nationkey AS old, c_custkey AS m FROM customer), n AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 99 ELSE c_nationkey END AS new, c_custkey AS m FROM customer),
c AS (SELECT new, old, count(*) AS c FROM n JOIN o USING (m) GROUP BY ALL), s AS (SELECT new, old, c / (x.k + y.k - c) AS jaccard FROM c JOIN (SELECT new, count(*) AS k FROM n GROUP BY new) x USING (new) JOIN (SELECT old, count(*) AS k FROM o GROUP BY old) y USING (old))
SELECT new, old, round(jaccard, 6) AS jaccard FROM s WHERE jaccard > 0.5""")
def community_carry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    old = customers.select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("member"))
    new = customers.select(F.when(F.col("c_custkey") % 9 == 0, 99).otherwise(F.col("c_nationkey")).alias("group"), F.col("c_custkey").alias("member"))
    return I.carry_ids(old, new, 0.500001).withColumn("jaccard", F.round("jaccard", 6))


@query()
def cluster_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by density of all vectors over their ten nearest; lists are made in blocks of vectors, each against all."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vectors = table(spark, sf_dir, "embeddings").filter(usable)
    near = S.knn(vectors, vectors.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 11)
    lists = near.filter("query <> vec_id").select(F.col("query").alias("id"), F.col("vec_id").alias("other"), F.greatest(1 - F.col("similarity"), F.lit(0.0)).alias("distance"))
    return D.density_groups(vectors.select(F.col("vec_id").alias("id")), lists).select("id", "group", F.round("strength", 6).alias("strength"), F.round("stability", 4).alias("stability"))
