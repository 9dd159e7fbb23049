"""Quality rules: robust multivariate outliers among document statistics, by DataFrame functions only.

Each document becomes a vector of transformed statistics. For every language
and source the minimum covariance determinant (MCD) estimate is found by
concentration steps from deterministic starts: keep the share ``SUPPORT`` of
vectors with the least Mahalanobis distance, take their mean and covariance,
repeat, and keep the start whose determinant ends least. A document is rejected
if its squared distance exceeds the chi-square quantile ``TAIL``.

Equal vectors count once in the fit, so a group of copies cannot shrink the
estimate around itself. A language and source with fewer than ``MIN_ROWS``
vectors is fitted with the other small sources of its language, those with all
that remain small; where even these are fewer, nothing is rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.llm import common

SUPPORT = 0.75
STEPS = 4
TAIL = 1e-5
MIN_ROWS = 60
MIN_WORDS = 50
#: Bins that quantiles are read from: of a statistic a unit, of a squared distance a doubling (above ``LEAST``).
BINS, DISTANCE_BINS, LEAST = 256, 64, 2.0**-20
#: Windows found again in a text up to which each window is looked up among them.
FEW = 32
#: Statistics and the standard deviation each is granted at least, so that a statistic that hardly varies rejects nothing by itself.
FLOORS = {"word_length": 0.15, "symbols": 0.15, "marks": 0.25, "capitals": 0.15, "repeats": 0.12, "dup_lines": 0.15}
NAMES = list(FLOORS)
P = len(NAMES)
LOWER_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: An estimate: the mean, and the rows of the inverse Cholesky factor one after the other.
ESTIMATE = ["array({}) AS m".format(", ".join(f"m{i}" for i in range(P))), "array({}) AS w".format(", ".join(f"w{i}{j}" for i, j in LOWER_PAIRS))]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the whole text; a null text counts as empty."""
    word = F.regexp_extract_all(F.col("_text"), F.lit(f"({common.WORD_PATTERN})"), F.lit(1))
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_words", word)
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    count = lambda pattern: F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))
    out = out.withColumn("n_symbols", count("[#*$%&|<>]+").cast("long"))
    out = out.withColumn("_marks", count("[!?.,;:]+")).withColumn("_capitals", count("[A-Z]+"))
    out = out.withColumn("_lines", F.expr(r"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    # Hashes of all 3-word windows; those found again are the equal neighbours once sorted.
    out = out.withColumn("_hashed", F.expr("transform(_words, w -> xxhash64(w))")).drop("_words", "_text")
    out = out.withColumn("_windows", F.expr("if(size(_hashed) < 3, array(), transform(sequence(0, size(_hashed) - 3), i -> xxhash64(_hashed[i], _hashed[i + 1], _hashed[i + 2])))")).drop("_hashed")
    out = out.withColumn("_sorted", F.expr("case when size(array_distinct(_windows)) < size(_windows) then sort_array(_windows) end"))
    out = out.withColumn("_again", F.expr("array_distinct(filter(_sorted, (h, k) -> h = get(_sorted, k + 1)))")).drop("_sorted")
    # Their places: by looking each window up among a few, else by sorting windows with their places.
    out = out.withColumn("_pairs", F.expr(f"case when size(_again) > {FEW} then sort_array(transform(_windows, (h, i) -> struct(h, i))) end"))
    few = f"when size(_again) <= {FEW} then filter(sequence(0, size(_windows) - 1), i -> array_contains(_again, _windows[i]))"
    many = "sort_array(transform(filter(transform(_pairs, (x, k) -> struct(x.i as i, x.h = get(_pairs, k - 1).h or x.h = get(_pairs, k + 1).h as twice)), x -> x.twice), x -> x.i))"
    out = out.withColumn("_places", F.expr(f"case {few} when size(_again) > {FEW} then {many} end")).drop("_pairs", "_again", "_windows")
    covered = F.expr("aggregate(transform(_places, (x, k) -> least(3, coalesce(get(_places, k + 1), x + 3) - x)), 0L, (a, x) -> a + x)")
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def vector() -> dict[str, Column]:
    """The transformed statistics: logarithms of lengths and densities, square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.log((F.col("word_chars") + 25.0) / (n + 5.0)),
        "symbols": F.log1p(4.0 * F.col("n_symbols") / (n + 5.0)),
        "marks": F.log1p(4.0 * F.col("_marks") / (n + 5.0)),
        "capitals": F.log1p(4.0 * F.col("_capitals") / (n + 5.0)),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (n + 5.0)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chi_square_tail(p: int, x: float) -> float:
    """The probability that a chi-square variable of ``p`` degrees exceeds ``x``, by the series of the incomplete gamma function."""
    term = total = 2.0 / p
    k = 0
    while term > total * 1e-17:
        k += 1
        term *= x / 2 / (p / 2 + k)
        total += term
    return 1 - total * math.exp(-x / 2 + p / 2 * math.log(x / 2) - math.lgamma(p / 2))


def chi_square(p: int, tail: float) -> float:
    """The value that a chi-square variable of ``p`` degrees exceeds with probability ``tail``."""
    low, high = 1e-9, 400.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(p, middle) > tail else (low, middle)
    return low


def consistency(p: int, share: float) -> float:
    """What the covariance of the nearest ``share`` of normal vectors falls short by."""
    return share / (1 - chi_square_tail(p + 2, chi_square(p, 1 - share)))


def _plus(terms: list[str]) -> str:
    return " + ".join(terms) or "0D"


def _estimate(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, inverse Cholesky factor (rows w) and log determinant from counts, sums and products.

    SQL text rather than Column objects: the expressions have hundreds of terms.
    """
    factor, means = consistency(P, SUPPORT), [f"m{i}" for i in range(P)]
    out = moments.selectExpr(*keys, *[f"s{i} / n AS m{i}" for i in range(P)], *[f"p{i}{j} / n AS p{i}{j}" for i, j in LOWER_PAIRS])
    floors = [x * x for x in FLOORS.values()]
    out = out.selectExpr(*keys, *means, *[f"{factor!r} * (p{i}{j} - m{i} * m{j}) + {floors[i] if i == j else 0.0!r} AS c{i}{j}" for i, j in LOWER_PAIRS])
    for k in range(P):  # Cholesky factor l, a column at a time
        less = {i: _plus([f"l{i}{q} * l{k}{q}" for q in range(k)]) for i in range(k, P)}
        out = out.selectExpr("*", f"sqrt(greatest(c{k}{k} - ({less[k]}), 1e-9D)) AS l{k}{k}")
        out = out.selectExpr("*", *[f"(c{i}{k} - ({less[i]})) / l{k}{k} AS l{i}{k}" for i in range(k + 1, P)])
    for i in range(P):  # its inverse w, a row at a time
        out = out.selectExpr("*", f"1 / l{i}{i} AS w{i}{i}", *[f"-({_plus([f'l{i}{q} * w{q}{j}' for q in range(j, i)])}) / l{i}{i} AS w{i}{j}" for j in range(i)])
    return out.selectExpr(*keys, *ESTIMATE, f"2 * ({_plus([f'ln(l{i}{i})' for i in range(P)])}) AS log_det")


def squared_distance() -> Column:
    """The squared Mahalanobis distance of a row that holds both its vector and an estimate."""
    return F.expr(_plus([f"pow({_plus([f'w[{LOWER_PAIRS.index((i, j))}] * ({NAMES[j]} - m[{j}])' for j in range(i + 1)])}, 2)" for i in range(P)]))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [f"sum({NAMES[i]}) AS s{i}" for i in range(P)] + [f"sum({NAMES[i]} * {NAMES[j]}) AS p{i}{j}" for i, j in LOWER_PAIRS]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.expr(x) for x in sums])


def with_cells(vectors: DataFrame, salt_by: list[str]) -> DataFrame:
    """Add the cell (language, source) each vector is fitted in; see the module's text for small ones. ``cell_rows`` counts distinct vectors."""
    rows = vectors.select("lang", "source", *NAMES).distinct()
    counts = common.written(rows.groupBy("lang", "source").agg(F.count("*").alias("_n")), "quality-counts")
    pooled = common.written(counts.filter(F.col("_n") < MIN_ROWS).groupBy("lang").agg(F.sum("_n").alias("_pool")), "quality-pools")
    cells = common.attach(counts, pooled, ["lang"], salt_by=["source"])
    own, pool = F.col("_n") >= MIN_ROWS, F.col("_pool") >= MIN_ROWS
    level = F.when(own, F.lit(2)).when(pool, F.lit(1)).otherwise(F.lit(0))
    cells = cells.select("lang", "source", level.alias("_level"))
    cell = F.when(F.col("_level") == 2, F.to_json(F.struct("_level", "lang", "source"))).when(F.col("_level") == 1, F.to_json(F.struct("_level", "lang"))).otherwise(F.lit("{}"))
    return common.attach(vectors, common.written(cells.withColumn("cell", cell).drop("_level"), "quality-cells"), ["lang", "source"], salt_by=salt_by)


def _quantiles(binned: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """The bins at which ``shares`` of each key's rows (keys, bin) are reached, as ``_q0``, ``_q1`` and so on.

    Rows are counted by bin before and after the shuffle, so a key with most of
    the rows is spread over its bins; what is ordered by key is a row a bin.
    """
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    by_key = Window.partitionBy(*keys)
    summed = counts.withColumn("_upto", F.sum("n").over(by_key.orderBy("bin"))).withColumn("_all", F.sum("n").over(by_key))
    return summed.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= p * F.col("_all"), F.col("bin"))).alias(f"_q{i}") for i, p in enumerate(shares)])


def fit(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """The MCD estimate of every cell with enough distinct vectors, as a written table with one row a cell.

    ``vectors`` has ``cell`` and the statistics. Work is a few passes over the
    narrow table of distinct vectors; only sums and counts by bin are shuffled.
    """
    with common.scope():
        rows = common.written(vectors.select("cell", *NAMES).distinct(), "quality-vectors")
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.round(F.col(c) * BINS).cast("long").alias("bin")) for i, c in enumerate(NAMES)])).alias("_b")
        found = _quantiles(rows.select("cell", each).select("cell", "_b.of", "_b.bin"), ["cell", "of"], [0.25, 0.5, 0.75])
        sides = [F.max(F.when(F.col("of") == i, F.array(*[F.col(f"_q{k}") / BINS for k in range(3)]))).alias(f"q_{c}") for i, c in enumerate(NAMES)]
        many = rows.groupBy("cell").agg(F.count("*").alias("cell_rows")).filter(F.col("cell_rows") >= MIN_ROWS)
        quartiles = common.written(many.join(found.groupBy("cell").agg(*sides), "cell"), "quality-quartiles")
        scaled = [F.pow((F.col(c) - F.col(f"q_{c}")[1]) / F.greatest((F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]) / 1.349, F.lit(FLOORS[c])), 2) for c in NAMES]
        start = common.attach(rows, quartiles, ["cell"], salt_by=NAMES[:1], how="inner")
        first = F.explode(F.array(F.struct(F.lit(0).alias("start"), sum(scaled, F.lit(0.0)).alias("d2")), F.struct(F.lit(1).alias("start"), F.greatest(*scaled).alias("d2"))))
        measured = start.select("cell", *NAMES, first.alias("_s")).select("cell", *NAMES, "_s.start", "_s.d2")
        keys, twice = ["cell", "start"], rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
        distance_bin = F.floor(F.log2(F.col("d2") + LEAST) * DISTANCE_BINS)
        for step in range(steps + 1):
            cut = common.written(_quantiles(measured.select(*keys, distance_bin.alias("bin")), keys, [SUPPORT]).withColumnRenamed("_q0", "_cut"), "quality-cut")
            nearest = common.attach(measured, cut, keys, salt_by=NAMES[:1], how="inner").filter(distance_bin <= F.col("_cut"))
            estimate = common.written(_estimate(_moments(nearest, keys), keys), f"quality-step{step}")
            measured = common.attach(twice, estimate.drop("log_det"), keys, salt_by=NAMES[:1], how="inner").select(*keys, *NAMES, squared_distance().alias("d2"))
        best = estimate.groupBy("cell").agg(F.min_by(F.struct("m", "w"), F.struct("log_det", "start")).alias("_e"))
        return common.written(best.select("cell", "_e.*"), "quality-estimate", keep=True)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _judged(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as _in0, _in1 and so on, so that none clashes with what is added: counts, distance and verdict."""
    rows = docs.select(*[F.col(c).alias(f"_in{i}") for i, c in enumerate(columns)], "text", "lang", "source")
    rows = statistics(rows).drop("text")
    rows = common.written(rows.withColumns(vector()).withColumn("base_failed", base_failed()), "quality-rows")
    salt_by = [*[f"_in{i}" for i, c in enumerate(columns) if c == "doc_id"], NAMES[0]]
    rows = with_cells(rows, salt_by)
    estimate = fit(rows.filter(~F.col("base_failed")))
    judged = common.attach(rows, estimate, ["cell"], salt_by=salt_by).withColumn("distance2", squared_distance())
    outlier = F.coalesce(F.col("distance2") > chi_square(P, TAIL), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~outlier)


def judge(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every document with its counts, distance and verdict.

    A row for each row of ``docs``, repeated ones included. A null text counts
    as empty and fails the base rule; null languages and sources form cells of
    their own; an empty table gives an empty result.
    """
    return _judged(docs, columns).select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(columns)], *COUNTS, "kept", "distance2")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``, by ``judge``: null and empty texts fail the base rule, a text of any length is read whole, rows that repeat are judged alike, an empty table gives an empty result."""
    return judge(common.documents(spark, sf_dir), ["doc_id"])


@common.staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, all their columns unchanged.

    Null and empty texts go (fewer words than the base rule asks for); null
    languages and sources are cells of their own; repeated rows stay or go
    together; an empty table gives an empty result; no column name is reserved.
    """
    kept = _judged(docs, docs.columns).filter("kept")
    return kept.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])
