"""Groups by density over neighbour lists: a spanning forest by Boruvka's rounds, its tree, and the groups that last longest.

Equal distances are one event: all pieces that a distance joins come together at
once, so no order of equal pairs shows in the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakit.operators.graph import merge_chains
from stratakit.sources.scratch import settled

#: The greatest cosine distance; parts that no list connects come together here.
FAR = 2.0
#: The least distance that a rate is taken of.
LEAST = 1e-6


def reachability(points: DataFrame, neighbours: DataFrame, min_samples: int = 3, floor: float = 0.0) -> DataFrame:
    """(a, b, w) with a < b: mutual reachability of each listed pair.

    ``points`` (id), ``neighbours`` (id, other, distance), lists of bounded
    length. A pair's distance is the largest of its own and both core distances
    (that of the ``min_samples``-th neighbour, ``FAR`` where there are fewer), at
    least ``floor`` and at most ``FAR``. Rows with a null, of a point with itself
    or of unknown points go.
    """
    rows = neighbours.select("id", "other", F.col("distance").cast("double").alias("d")).filter("id <> other AND d IS NOT NULL")
    for end in ("id", "other"):
        rows = rows.join(points.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    core = rows.groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("_d")).select("id", F.coalesce(F.try_element_at("_d", F.lit(min_samples)), F.lit(FAR)).alias("core"))
    pairs = rows.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("d").alias("d"))
    ends = core.select(F.col("id").alias("a"), F.col("core").alias("_ca")), core.select(F.col("id").alias("b"), F.col("core").alias("_cb"))
    joined = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    far = lambda c: F.coalesce(F.col(c), F.lit(FAR))
    return joined.select("a", "b", F.least(F.greatest("d", far("_ca"), far("_cb"), F.lit(float(floor))), F.lit(FAR)).alias("w"))


def _rounds(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Boruvka's rounds: (id, under), the edge that first joins each point (null: none), and the forest's edges laid in chains.

    In a round each part takes its lightest edge out; parts joined by these are
    one in the next. A chain is a path of the tree of merges: an edge lies in the
    chain of the first later part around it whose lightest edge out is heavier,
    and that edge follows the chain. Chains: (level, part, e, under).
    """
    parts = points.select(F.col("id").alias("part")).distinct()
    held = settled(edges.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.struct("w", "a", "b").alias("e")), "reach-edges")
    waiting, first, chains, level = None, None, [], 0
    while True:
        out = held.select(F.col("pa").alias("part"), "e", F.col("pb").alias("other")).unionByName(held.select(F.col("pb").alias("part"), "e", F.col("pa").alias("other")))
        least = out.groupBy("part").agg(F.min(F.struct("e", "other")).alias("_m")).select("part", "_m.e", "_m.other")
        light = settled(parts.join(least, "part", "left"), "lightest")
        first = light.select(F.col("part").alias("id"), F.col("e").alias("under")) if first is None else first
        if waiting is not None:
            at = settled(waiting.join(light.select("part", F.col("e").alias("under")), "part"), "climbing")
            chains.append(at.filter("under IS NULL OR under > e").select(F.lit(level).alias("level"), "part", "e", "under"))
            waiting = at.filter("under < e").select("part", "e")
        taken = light.filter("e IS NOT NULL")
        if not taken.limit(1).count():
            return first, reduce(DataFrame.unionByName, chains) if chains else _no_chains(light), level
        mates = taken.select(F.col("part").alias("other"), F.col("e").alias("_e"))
        up = taken.join(mates, "other").filter(~((F.col("e") == F.col("_e")) & (F.col("part") < F.col("other"))))
        whole = merge_chains(settled(up.select(F.col("part").alias("id"), F.col("other").alias("into")), "joined-parts"), 62)
        to = settled(parts.join(whole.withColumnRenamed("id", "part"), "part", "left").select("part", F.coalesce("cid", "part").alias("whole")), "parts")
        moved = taken.select("part", "e") if waiting is None else waiting.unionByName(taken.select("part", "e"))
        waiting = settled(moved.join(to, "part").select(F.col("whole").alias("part"), "e").distinct(), "waiting")
        ends = to.select(F.col("part").alias("pa"), F.col("whole").alias("_a")), to.select(F.col("part").alias("pb"), F.col("whole").alias("_b"))
        across = held.join(ends[0], "pa").join(ends[1], "pb").filter("_a <> _b")
        held = settled(across.groupBy(F.least("_a", "_b").alias("pa"), F.greatest("_a", "_b").alias("pb")).agg(F.min("e").alias("e")), "reach-edges")
        parts, level = to.select(F.col("whole").alias("part")).distinct(), level + 1


def _no_chains(light: DataFrame) -> DataFrame:
    """No chains, with their columns."""
    return light.select(F.lit(0).alias("level"), "part", "e", F.col("e").alias("under")).filter("false")


def forest(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, w): the spanning forest of least weight; equal weights by a, b."""
    return _rounds(points, edges)[1].select("e.a", "e.b", "e.w")


def _root() -> Column:
    return F.struct(F.lit(FAR).alias("w"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))


def _merges(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(e, up, size), each forest edge with the merge after it and the points it joins, and (id, under) of the points.

    Chains are cut by ranges of their order, so that one of any length is shared
    by many tasks. Chains of a level hang on edges of chains of later levels only:
    sizes are sums along chains, level by level.
    """
    first, chains, levels = _rounds(points, edges)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(chains.repartitionByRange(n, "level", "part", "e").withColumn("block", F.spark_partition_id()), "chains")
    chain, inside = ["level", "part"], Window.partitionBy("level", "part", "block").orderBy("e")
    heads = rows.groupBy(*chain, "block").agg(F.min("e").alias("_e"))
    heads = heads.withColumn("_follows", F.lead("_e").over(Window.partitionBy(*chain).orderBy("block"))).drop("_e")  # a row a task at most
    ups = rows.withColumn("_next", F.lead("e").over(inside)).join(heads, [*chain, "block"]).select("e", F.coalesce("_next", "_follows", "under", _root()).alias("up"))
    hung = first.filter("under IS NOT NULL").groupBy(F.col("under").alias("e")).agg(F.count("*").alias("n"))
    sizes = []
    for level in range(1, levels + 1):
        own = settled(rows.filter(F.col("level") == level).join(hung.groupBy("e").agg(F.sum("n").alias("n")), "e"), "hung")
        before = own.groupBy("part", "block").agg(F.sum("n").alias("_n"))
        before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
        upto = F.sum("n").over(inside) + F.coalesce("_before", F.lit(0))
        sizes.append(own.join(before, ["part", "block"]).select("e", upto.alias("size")))
        hung = settled(hung.unionByName(own.filter("under IS NOT NULL").groupBy(F.col("under").alias("e")).agg(F.sum("n").alias("n"))), "hung-sums")
    if not sizes:
        return ups.withColumn("size", F.lit(0).cast("long")), first
    return settled(ups.join(reduce(DataFrame.unionByName, sizes), "e"), "merges"), first


def _flat(df: DataFrame, key: str, to: str, out: str, rows: DataFrame) -> DataFrame:
    """``rows`` (key, ...) with ``out``: where the pointers of ``df`` (key, to) end from it."""
    flat = merge_chains(settled(df.select(F.col(key).alias("id"), F.col(to).alias("into")), "pointers"), 62)
    return rows.join(flat.select(F.col("id").alias(key), F.col("cid").alias("_end")), key, "left").withColumn(out, F.coalesce("_end", key)).drop("_end")


def _values(kin: DataFrame) -> DataFrame:
    """(c, value) of clusters (c, up, s): the greater of its own ``s`` and what those right below are worth together.

    In a round all leaves are valued and go, and a chain of clusters with one
    below each, worth at least ``fs`` and else ``fb`` more than its lower end, is
    made one step. So rounds follow the logarithm of the clusters, however deep
    their tree is. ``gs`` and ``gb`` say the same of the steps left out above a
    cluster.
    """
    none = float("-inf")
    left = kin.select("c", "up", "s", F.lit(0.0).alias("b"), F.lit(none).alias("gs"), F.lit(0.0).alias("gb"))
    valued, chains = [], []
    while True:
        kids = left.filter("up IS NOT NULL").groupBy(F.col("up").alias("c")).agg(F.count("*").alias("m"))
        counted = settled(left.join(kids, "c", "left"), "counted")
        value = F.when(F.round("b", 9) > F.round("s", 9), F.col("b")).otherwise(F.col("s"))
        ready = counted.filter("m IS NULL").select("c", "up", value.alias("value"), F.greatest("gs", F.col("gb") + value).alias("_given"))
        valued.append(ready.select("c", "value"))
        given = ready.filter("up IS NOT NULL").groupBy(F.col("up").alias("c")).agg(F.sum("_given").alias("_b"), F.count("*").alias("_n"))
        rest = counted.filter("m IS NOT NULL").join(given, "c", "left")
        rest = settled(rest.select("c", "up", "s", (F.col("b") + F.coalesce("_b", F.lit(0.0))).alias("b"), "gs", "gb", (F.col("m") - F.coalesce("_n", F.lit(0))).alias("m")), "left")
        if rest.isEmpty():
            break
        single = rest.filter("m = 1")
        below = rest.filter("up IS NOT NULL").select(F.col("up").alias("c"), F.col("c").alias("to"), F.col("gs").alias("_s"), F.col("gb").alias("_b"))
        steps = single.join(below, "c").select("c", "to", F.greatest("s", F.col("b") + F.col("_s")).alias("fs"), (F.col("b") + F.col("_b")).alias("fb"))
        while True:
            steps = settled(steps, "steps")
            on = steps.select(F.col("c").alias("to"), F.col("to").alias("_to"), F.col("fs").alias("_fs"), F.col("fb").alias("_fb"))
            if steps.join(on, "to", "left_semi").isEmpty():
                break
            steps = steps.join(on, "to", "left").select("c", F.coalesce("_to", "to").alias("to"), F.greatest("fs", F.col("fb") + F.coalesce("_fs", F.lit(none))).alias("fs"), (F.col("fb") + F.coalesce("_fb", F.lit(0.0))).alias("fb"))
        chains.append(steps)
        ends = single.join(single.select(F.col("c").alias("up")), "up", "left_anti").select("c", F.col("up").alias("_up"), F.col("gs").alias("_s"), F.col("gb").alias("_b"))
        ends = steps.join(ends, "c").select(F.col("to").alias("c"), "_up", F.greatest("_s", F.col("_b") + F.col("fs")).alias("_gs"), (F.col("_b") + F.col("fb")).alias("_gb"))
        moved = rest.filter("m <> 1").join(ends, "c", "left")
        left = moved.select("c", F.when(F.col("_gb").isNull(), F.col("up")).otherwise(F.col("_up")).alias("up"), "s", "b", F.coalesce("_gs", "gs").alias("gs"), F.coalesce("_gb", "gb").alias("gb"))
    out = settled(reduce(DataFrame.unionByName, valued), "values")
    for steps in reversed(chains):
        inner = steps.join(out.withColumnRenamed("c", "to"), "to").select("c", F.greatest("fs", F.col("fb") + F.col("value")).alias("value"))
        out = settled(out.unionByName(inner), "values")
    return out


def _chosen(clusters: DataFrame) -> DataFrame:
    """(c, top): each cluster (c, up, stability) with the chosen one it belongs to, null where none is.

    A cluster is chosen unless those below last longer together; of chosen ones
    above each other the uppermost stands.
    """
    kin = settled(clusters.select("c", "up", "stability"), "clusters")
    worth = _values(kin.withColumnRenamed("stability", "s"))
    below = kin.join(worth, "c").filter("up IS NOT NULL").groupBy(F.col("up").alias("c")).agg(F.sum("value").alias("_below"))
    split = F.coalesce(F.round("_below", 9) > F.round("stability", 9), F.lit(False))
    valued = kin.join(below, "c", "left").select("c", "up", (~split & (F.round("stability", 9) > 0)).alias("chosen"))
    at = settled(valued.select("c", "up", F.when(F.col("chosen"), F.col("c")).alias("top")), "tops")
    while True:
        above = at.select(F.col("c").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        at = settled(at.join(above, "up", "left").select("c", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")), "tops")
        if not at.filter("up IS NOT NULL").limit(1).count():
            return at.select("c", "top")


def density_groups(points: DataFrame, neighbours: DataFrame, min_size: int = 3, min_samples: int = 3, floor: float = 0.0) -> DataFrame:
    """(id, group, strength, stability): a row for each point; ``group`` is its least id, null for noise (strength 0).

    ``points`` (id: long), ``neighbours`` (id, other, distance). As distances
    shrink, groups of ``min_size`` points or more come apart; a group counts what
    its points last in it, in rates of one over the distance, and those with the
    most stand. The whole is never a group. Strength is where a point left over
    where the last of its group did. Repeated points count once; null ids go.
    """
    if min_size < 2:
        raise ValueError("a group has two points at least")
    points = settled(points.select(F.col("id").cast("long").alias("id")).filter("id IS NOT NULL").distinct(), "points")
    merges, first = _merges(points, reachability(points, neighbours, min_samples, floor))
    rate = lambda e: 1 / F.greatest(e["w"], F.lit(LEAST))
    # Merges at one distance, one above the other, are one event.
    whole = settled(_flat(merges.filter("e.w = up.w"), "e", "up", "event", merges), "events")
    ups = whole.select(F.col("e").alias("up"), F.col("event").alias("_upper"))
    tops = whole.filter("e = event").join(ups, "up", "left").select("event", "size", F.coalesce("_upper", "up").alias("up"))
    root = points.agg(F.count("*").alias("size")).select(_root().alias("event"), "size", F.lit(None).cast("struct<w:double,a:bigint,b:bigint>").alias("up"))
    events = settled(tops.unionByName(root), "event-sizes")
    big = events.filter(F.col("size") >= min_size)
    kids = big.filter("up IS NOT NULL").groupBy(F.col("up").alias("event")).agg(F.count("*").alias("kids"), F.sum("size").alias("kept"))
    big = settled(big.join(kids, "event", "left").fillna(0, ["kids", "kept"]), "large-events")
    split = kids.filter("kids >= 2").select(F.col("event").alias("up"), F.lit(True).alias("_born"))
    kept = settled(big.join(split, "up", "left"), "kept-events")
    held = settled(_flat(kept.filter("up IS NOT NULL AND _born IS NULL"), "event", "up", "c", kept), "cluster-events")
    birth = held.filter("event = c").select("c", F.coalesce(rate(F.col("up")), F.lit(0.0)).alias("_birth"), F.col("up").alias("_up"))
    birth = birth.join(held.select(F.col("event").alias("_up"), F.col("c").alias("_uc")), "_up", "left").drop("_up")
    leaving = F.when(F.col("kids") >= 2, F.col("size")).otherwise(F.col("size") - F.col("kept"))
    last = held.join(birth, "c").groupBy("c", F.col("_uc").alias("up")).agg(F.sum(leaving * (rate(F.col("event")) - F.col("_birth"))).alias("stability"))
    clusters = settled(last.filter("up IS NOT NULL").withColumn("up", F.when(F.col("up") != _root(), F.col("up"))), "clusters")
    top = held.filter("up IS NULL").select("c")
    clusters = clusters.join(top.select(F.col("c").alias("up"), F.lit(True).alias("_top")), "up", "left").withColumn("up", F.when(F.col("_top").isNull(), F.col("up"))).drop("_top")
    # Events too small for a group lie less than ``min_size`` deep.
    small = _flat(events.filter(F.col("size") < min_size), "event", "up", "holds", events).select("event", "holds")
    at = first.join(whole.select(F.col("e").alias("under"), "event"), "under", "left").withColumn("event", F.coalesce("event", _root()))
    at = at.join(small, "event", "left").select("id", F.col("holds").alias("event")).join(held.select("event", "c"), "event", "left")
    at = settled(at.join(_chosen(clusters), "c", "left").select("id", "top", rate(F.col("event")).alias("_left")), "placed")
    groups = at.filter("top IS NOT NULL").groupBy("top").agg(F.min("id").alias("group"), F.max("_left").alias("_most"))
    groups = groups.join(clusters.select(F.col("c").alias("top"), "stability"), "top")
    strength = F.when(F.col("group").isNotNull(), F.least(F.lit(1.0), F.col("_left") / F.col("_most"))).otherwise(0.0)
    return at.join(groups, "top", "left").select("id", "group", strength.alias("strength"), "stability")
