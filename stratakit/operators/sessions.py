"""Sessions of dated items, nearest places and calibration statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def gap_sessions(rows: DataFrame, key: str, at: str, order: str, gap_seconds: int, cut: Column | None = None, keep: int = 1) -> DataFrame:
    """(key, session, first, last, n): runs of items with gaps below ``gap_seconds``; ``cut`` starts a run as well; runs of ``keep`` or more stay."""
    w = Window.partitionBy(key).orderBy(at, order)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    new = F.coalesce(gap >= gap_seconds * 1_000_000, F.lit(True))
    new = new | F.coalesce(cut, F.lit(False)) if cut is not None else new
    runs = rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= keep)


def dominant_value(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, value): the value that at least ``share`` of a group's known values have."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    return counts.withColumn("share", F.col("_n") / total).filter(F.col("share") >= share).drop("_n")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def nearest(points: DataFrame, towns: DataFrame, reach_km: float = 30.0) -> DataFrame:
    """(id, town, km): the nearest town (town, lat, lon) of each point (id, lat, lon) within reach.

    Points meet the towns of the one-degree cells around theirs, as many to each
    side as the reach spans at their latitude, across the date line; an
    equi-join on cells, so no pair is made beyond. Points at one place are
    compared once, and of towns at one place the least alone is.
    """
    held, points = points.select("id", "lat", "lon"), points.select("lat", "lon").distinct()
    towns = towns.groupBy("lat", "lon").agg(F.min("town").alias("town"))
    rows = F.ceil(F.lit(reach_km / 111.0)).cast("int")
    wide = F.least(F.lit(180), F.ceil(reach_km / (111.0 * F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + 1))), F.lit(0.01))))).cast("int")
    cells = points.withColumn("_r", F.explode(F.sequence((F.floor("lat") - rows).cast("int"), (F.floor("lat") + rows).cast("int"))))
    cells = cells.withColumn("_c", F.explode(F.array_distinct(F.transform(F.sequence((F.floor("lon") - wide).cast("int"), (F.floor("lon") + wide).cast("int")), lambda c: F.pmod(c + 180, F.lit(360))))))
    placed = towns.select("town", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.floor("lat").cast("int").alias("_r"), F.pmod(F.floor("lon").cast("int") + 180, F.lit(360)).alias("_c"))
    near = cells.join(placed, ["_r", "_c"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).filter(F.col("km") <= reach_km)
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("km", "town")).alias("_b"))
    return held.join(best, ["lat", "lon"]).groupBy("id").agg(F.min("_b").alias("_b")).select("id", "_b.town", "_b.km")


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, said, happened): equal bins of p; 1.0 belongs to the last."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    return rows.groupBy(at).agg(F.count("*").alias("n"), F.avg("p").alias("said"), F.avg("y").alias("happened"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    r = reliability(rows, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("said") - F.col("happened"))) / F.sum("n")).alias("ece"))


def platt(rows: DataFrame, steps: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the logit of p by Newton's method; each step sums five numbers over all rows."""
    a, b = 1.0, 0.0
    logit = rows.select(F.log(F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)))).alias("x"), F.col("y").cast("double").alias("y")).cache()
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w = logit.select("x", "y", q.alias("q")).agg(F.sum((F.col("q") - F.col("y")) * F.col("x")), F.sum(F.col("q") - F.col("y")), F.sum(F.col("q") * (1 - F.col("q")) * F.col("x") ** 2), F.sum(F.col("q") * (1 - F.col("q")) * F.col("x")), F.sum(F.col("q") * (1 - F.col("q")))).first()
        ga, gb, haa, hab, hbb = (v or 0.0 for v in w)
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-18:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    logit.unpersist()
    return a, b


def isotonic(rows: DataFrame) -> DataFrame:
    """(bound, value): the isotonic fit of y on p, by MLlib, equal values of p pooled first."""
    from pyspark.ml.regression import IsotonicRegression

    pooled = rows.groupBy("p").agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight")).withColumnRenamed("p", "features")
    model = IsotonicRegression(weightCol="weight").fit(pooled)
    return rows.sparkSession.createDataFrame([(float(x), float(v)) for x, v in zip(model.boundaries, model.predictions, strict=True)], "bound double, value double")


def neighbour_votes(queries: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(query, label, votes, similarity, margin) from each query's k nearest labelled rows (query, label, similarity).

    Most votes win, ties go to the higher best similarity, then the label;
    the margin is to the best of any other label, 1 if there is none.
    """
    near = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    top = known.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k)
    votes = top.groupBy("query", "label").agg(F.count("*").alias("votes"), F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.desc("votes"), F.desc("similarity"), "label")
    ranked = votes.withColumn("_r", F.row_number().over(order))
    other = ranked.groupBy("query").agg(F.max(F.when(F.col("_r") > 1, F.col("similarity"))).alias("_other"))
    return queries.join(ranked.filter("_r = 1"), "query").join(other, "query").select("query", "label", "votes", "similarity", F.coalesce(F.col("similarity") - F.col("_other"), F.lit(1.0)).alias("margin"))
