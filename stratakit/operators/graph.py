"""Reads over a bi-temporal evidence graph.

Edges are an append-only table: id, src, rel, dst, confidence, source_doc,
valid_from and valid_to (record time, ISO strings; null: in force), world_from
and world_to (partial dates or null). Entities are canonicalised by one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.sources.scratch import settled

# Fixed values of the graph reads.
FIRST_HOP, SECOND_PER_TYPE, SECOND_TOTAL = 150, 12, 40
BASE_COST = {"strong": 1.0, "medium": 2.0, "weak": 3.0}
CONFIDENCE_COST = {"EXTRACTED": 1.0, "INFERRED": 1.35, "AMBIGUOUS": 2.0}
HUB_DEGREE, SOUND = 1500, 7.0


def last_moment(day: str) -> str:
    """The last moment of a year, month or day, as compared by string; every month ends on the 31st."""
    return {4: f"{day}-12-31T23:59:59Z", 7: f"{day}-31T23:59:59Z", 10: f"{day}T23:59:59Z"}.get(len(day), day)


def held_at(as_of: str | None = None) -> Column:
    """In force in record time, now or at a moment."""
    if as_of is None:
        return F.col("valid_to").isNull()
    t = last_moment(as_of)
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def held_in_world(at: str) -> Column:
    """Does the world time overlap a partial date, at the coarser precision of the two? An open or undated end passes."""
    shorter = lambda c: F.least(F.length(c), F.lit(len(at)))
    cut = lambda c: F.substring(c, F.lit(1), shorter(c))
    day = lambda c: F.substring(F.lit(at), F.lit(1), shorter(c))
    begins = F.col("world_from").isNull() | (cut(F.col("world_from")) <= day(F.col("world_from")))
    ends = F.col("world_to").isNull() | (cut(F.col("world_to")) >= day(F.col("world_to")))
    return begins & ends


def canonical(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """Edges with src and dst replaced by the entities they were merged into; ``canon`` (id, cid)."""
    out = edges
    for end in ("src", "dst"):
        names = canon.select(F.col("id").alias("_id"), F.col("cid").alias("_cid"))
        out = out.join(names, out[end] == F.col("_id"), "left").withColumn(end, F.coalesce("_cid", end)).drop("_id", "_cid")
    return out


def merge_chains(merges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, cid) with every chain of merges (id, into) flattened; pointers double in each round."""
    at = merges.select("id", F.col("into").alias("cid"))
    for _ in range(rounds):
        step = at.select(F.col("id").alias("_id"), F.col("cid").alias("_next"))
        joined = settled(at.join(step, F.col("cid") == F.col("_id"), "left"), "merges")
        more = joined.filter("_next IS NOT NULL").limit(1).count()
        at = joined.select("id", F.coalesce("_next", "cid").alias("cid"))
        if not more:
            return at
    raise RuntimeError(f"merges in a cycle, or a chain longer than 2 ** {rounds}")


def ends(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: (node, other, and the edge's columns)."""
    return edges.withColumn("node", F.col("src")).withColumn("other", F.col("dst")).unionByName(edges.withColumn("node", F.col("dst")).withColumn("other", F.col("src")))


def degree(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("source_doc").alias("docs"))


def first_hop(edges: DataFrame, start: int, limit: int = FIRST_HOP) -> DataFrame:
    """Facts at a node, at most ``limit``: distinct facts before repeats, relations taking turns, best supported first.

    ``support`` is the number of documents of a fact. Relations with more
    distinct facts go first in each turn; names break ties.
    """
    near = edges.filter((F.col("src") == start) | (F.col("dst") == start))
    fact = Window.partitionBy("src", "rel", "dst")
    near = near.withColumn("_doc", F.dense_rank().over(fact.orderBy("source_doc"))).withColumn("support", F.max("_doc").over(fact)).withColumn("_copy", F.row_number().over(fact.orderBy("id")))
    firsts = near.filter("_copy = 1").groupBy("rel").agg(F.count("*").alias("_facts"))
    turn = Window.partitionBy("rel", F.col("_copy") > 1).orderBy(F.desc("support"), "id")
    placed = near.join(firsts, "rel").withColumn("_turn", F.row_number().over(turn))
    order = [F.col("_copy") > 1, F.when(F.col("_copy") == 1, F.col("_turn")).otherwise(0), F.when(F.col("_copy") == 1, -F.col("_facts")).otherwise(0), "rel", F.col("_turn")]
    return placed.orderBy(*order).limit(limit).select("id", "src", "rel", "dst", "support")


def second_hop(edges: DataFrame, types: DataFrame, start: int) -> DataFrame:
    """(other, type, docs) two hops away: not met before, most documents first, at most 12 of a type and 40 in all."""
    both = ends(edges).select("node", "other", "source_doc")
    one = both.filter(F.col("node") == start).select(F.col("other").alias("n1")).distinct()
    two = one.join(both, F.col("n1") == F.col("node")).filter(F.col("other") != start)
    two = two.join(one.select(F.col("n1").alias("_met")), F.col("other") == F.col("_met"), "left_anti")
    ranked = two.groupBy("other").agg(F.count_distinct("source_doc").alias("docs")).join(types.select(F.col("id").alias("other"), "type"), "other")
    per = Window.partitionBy("type").orderBy(F.desc("docs"), "other")
    return ranked.withColumn("_r", F.row_number().over(per)).filter(F.col("_r") <= SECOND_PER_TYPE).orderBy(F.desc("docs"), "other").limit(SECOND_TOTAL).drop("_r")


def facts(edges: DataFrame) -> DataFrame:
    """(src, rel, dst, docs, confidence, cost): edges grouped to facts with the price of a hop."""
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in CONFIDENCE_COST.items() for x in (k, v)]), F.col("confidence"))
    grouped = edges.groupBy("src", "rel", "dst").agg(F.count_distinct("source_doc").alias("docs"), F.min(rank).alias("_c"), F.min("strength").alias("strength"))
    base = F.element_at(F.create_map(*[F.lit(x) for k, v in BASE_COST.items() for x in (k, v)]), F.col("strength"))
    return grouped.withColumn("cost", base * F.col("_c") / (1 + F.log2(F.greatest(F.lit(1), F.col("docs"))))).drop("_c")


def cheapest_paths(graph: DataFrame, start: int, goal: int, hops: int = 3, k: int = 3) -> DataFrame:
    """The k cheapest simple paths of at most ``hops`` hops between two nodes.

    ``graph`` is ``facts``. Passing a node costs half the logarithm of its
    degree more; nodes above 1,500 links can't be passed; ends are free. Of
    paths through the same inner nodes the cheapest counts. Frontiers keep only
    nodes that the goal's side still reaches in the hops left.
    """
    step = ends(graph.withColumn("source_doc", F.lit(0)).withColumn("id", F.lit(0))).groupBy("node", "other").agg(F.min("cost").alias("cost"))
    step = settled(step, "hops")
    deg = ends(graph.withColumn("source_doc", F.lit(0))).groupBy("node").agg(F.count("*").alias("_deg"))
    toll = deg.select(F.col("node").alias("_at"), F.when(F.col("_deg") <= HUB_DEGREE, 0.5 * F.log1p(F.col("_deg"))).alias("_toll"))
    reach = [step.filter(F.col("other") == goal).select("node").distinct()]
    for _ in range(hops - 2):
        reach.append(reach[-1].unionByName(reach[-1].select(F.col("node").alias("_n")).join(step, F.col("_n") == F.col("other")).select("node")).distinct())
    paths = step.filter(F.col("node") == start).select(F.array("node", "other").alias("path"), F.col("other").alias("at"), "cost")
    found = paths.filter(F.col("at") == goal)
    for hop in range(1, hops):
        left = reach[hops - hop - 1]
        inner = paths.filter(F.col("at") != goal).join(left.select(F.col("node").alias("_ok")), F.col("at") == F.col("_ok"), "left_semi")
        inner = inner.join(toll, F.col("at") == F.col("_at")).filter("_toll IS NOT NULL").select("path", "at", (F.col("cost") + F.col("_toll")).alias("cost"))
        paths = inner.join(step.withColumnRenamed("cost", "_c"), F.col("at") == F.col("node")).filter(~F.array_contains("path", F.col("other")))
        paths = paths.select(F.concat("path", F.array("other")).alias("path"), F.col("other").alias("at"), (F.col("cost") + F.col("_c")).alias("cost"))
        found = found.unionByName(paths.filter(F.col("at") == goal))
    inner_set = F.array_join(F.array_sort(F.slice("path", 2, F.size("path") - 2)), ",")
    best = found.withColumn("_set", inner_set).withColumn("_r", F.row_number().over(Window.partitionBy("_set").orderBy("cost", F.array_join("path", ",")))).filter("_r = 1")
    return best.orderBy("cost", F.array_join("path", ",")).limit(k).select("path", "cost")


def hubs(edges: DataFrame, limit: int) -> DataFrame:
    """(node, degree, docs) of the most connected."""
    return degree(edges).orderBy(F.desc("degree"), "node").limit(limit)


def co_documents(edges: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(a, b, shared) of chosen nodes that ``least`` documents or more speak of together; ``nodes`` is a bounded set."""
    held = ends(edges).join(F.broadcast(nodes.select(F.col("node").alias("_n"))), F.col("node") == F.col("_n"), "left_semi").select("node", "source_doc").distinct()
    other = held.select(F.col("node").alias("b"), "source_doc")
    pairs = held.join(other, "source_doc").filter("node < b")
    return pairs.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def changes(edges: DataFrame, since: str, until: str, world: bool = False, rereadings: bool = True) -> DataFrame:
    """Edges that were added or ended (in the world: began or ended) in a period, bounds included.

    Without ``rereadings`` an added edge goes whose fact another edge held at the
    period's start, and an ended one whose fact another edge still holds.
    """
    begin, end = ("world_from", "world_to") if world else ("valid_from", "valid_to")
    kinds = ("began", "ended") if world else ("added", "ended")
    last = until if world else last_moment(until)
    added = edges.filter(F.col(begin).between(since, last)).withColumn("kind", F.lit(kinds[0])).withColumn("at", F.col(begin))
    ended = edges.filter(F.col(end).between(since, last)).withColumn("kind", F.lit(kinds[1])).withColumn("at", F.col(end))
    if not rereadings:
        other = lambda e, c: e.filter(c).select(F.col("id").alias("_id"), F.col("src").alias("_s"), F.col("rel").alias("_r"), F.col("dst").alias("_d"))
        same = lambda: (F.col("src") == F.col("_s")) & (F.col("rel") == F.col("_r")) & (F.col("dst") == F.col("_d")) & (F.col("id") != F.col("_id"))
        before = (F.col("valid_from") < since) & (F.col("valid_to").isNull() | (F.col("valid_to") >= since))
        added = added.join(other(edges, before), same(), "left_anti")
        ended = ended.join(other(edges, F.col("valid_to").isNull()), same(), "left_anti")
    return added.unionByName(ended)


def senses(entities: DataFrame, labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(id, type, edges, docs) of the entities of a name (exact) or label (any case), the most connected first."""
    named = entities.filter(F.col("name") == name).select("id")
    labelled = labels.filter(F.lower("label") == name.lower()).select(F.col("entity_id").alias("id"))
    found = named.union(labelled).distinct().join(entities.select("id", "type"), "id")
    return found.join(degree(edges), F.col("id") == F.col("node")).select("id", "type", F.col("degree").alias("edges"), "docs")


def check_edges(edges: DataFrame, types: DataFrame, closure: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges with ``fits``: do the ends' types, or ancestors of them, stand in the relation's domain and range?

    ``types`` (id, type), ``closure`` (type, ancestor; reflexive), ``relations`` (rel, domain, range: arrays; empty: any).
    """
    up = closure.groupBy("type").agg(F.collect_set("ancestor").alias("_up"))  # ancestors of a type are few
    out = edges.join(F.broadcast(relations), "rel", "left")
    for end, place in (("src", "domain"), ("dst", "range")):
        at = types.join(up, "type").select(F.col("id").alias("_id"), F.col("_up").alias(f"_{end}_up"))
        out = out.join(at, F.col(end) == F.col("_id"), "left").drop("_id")
        out = out.withColumn(f"_{end}_ok", (F.size(place) == 0) | F.coalesce(F.arrays_overlap(f"_{end}_up", place), F.lit(False)))
    return out.withColumn("fits", F.coalesce(F.col("_src_ok") & F.col("_dst_ok"), F.lit(False))).drop("_src_up", "_dst_up", "_src_ok", "_dst_ok")


def visible(edges: DataFrame, hidden: DataFrame, premises: DataFrame | None = None) -> DataFrame:
    """Edges that a viewer may see: none of a hidden document, none derived from such an edge. Edges without a document stay."""
    out = edges.join(hidden.select(F.col("doc_id").alias("_h")), F.col("source_doc") == F.col("_h"), "left_anti")
    if premises is not None:
        gone = edges.join(hidden.select(F.col("doc_id").alias("_h")), F.col("source_doc") == F.col("_h"), "left_semi").select(F.col("id").alias("_gone"))
        bad = premises.join(gone, F.col("premise") == F.col("_gone"), "left_semi").select(F.col("edge").alias("_e"))
        out = out.join(bad, F.col("id") == F.col("_e"), "left_anti")
    return out
