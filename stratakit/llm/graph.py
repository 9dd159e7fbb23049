"""Connected components of a link table, by joins and written tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.llm import common

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the least node it reaches.

    Alternates large stars and small stars until no edge changes: the rounds grow
    as the logarithm of the longest chain. Neighbours are never gathered: minima
    are aggregated before they are shuffled and written, so that the join with a
    hub's edges is by broadcast or splits them among tasks.
    """
    with common.scope():
        edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = common.written(edges, "links")
        seen = None
        for _ in range(MAX_ROUNDS):
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == seen or not state[0]:
                break
            seen = state
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
            large = common.written(large, "large-star")
            least = common.written(large.groupBy("a").agg(F.min("b").alias("m")), "least-neighbours")
            small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
            edges = common.written(small.distinct(), "small-star")
        else:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return common.written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components", keep=True)
