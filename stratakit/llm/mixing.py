"""Mixing sources to target weights by pivotal dependent rounding, by DataFrame functions only.

Every source has a target number of words; each of its documents should be
taken target / size times. The whole part is certain. The fractions are rounded
in pairs: words move at random from one fraction to the other until one of the
two is 0 or 1, so the source's expected words never change and each fraction
keeps its expectation. Blocks of a bounded number of documents are rounded in
parallel down to one open fraction each; the open ones form blocks again, level
by level, until a source has one, which is rounded last.

Chance comes from hashes of ids (and of the place in the files, only for rows
whose doc_id repeats), so reruns agree however the work is parted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.llm import common

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Documents in a block on average, and open fractions of blocks in a block of the next level.
LEAF, BRANCH = 48, 32
SEED = 20
#: Bits of a row's number that tell its place in one of Spark's bitmaps.
BLOCK_BITS = 15
#: Bits below the partition in the ids that Spark gives rows in order.
PARTITION_BITS = 33

_ITEM = "STRUCT<k: BIGINT, h: BIGINT, row: BIGINT, p: DOUBLE, u: DOUBLE>"
_DONE = "STRUCT<row: BIGINT, up: INT>"


def n_words(text: Column) -> Column:
    """Words of a whole text; a null text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{common.SPACE_CLASS}+|{common.SPACE_CLASS}+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"{common.SPACE_CLASS}+"))).cast("long")


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, docs, target) for ``rows`` (source, size), a written table.

    Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share
    ``SHARE`` of all sizes; a target stops at ``CAP`` times its source's size,
    and the excess is shared by weight among the rest until none is above.
    Places come from a range partitioning of the sources, the rate of sharing
    from one sum over them in each round, so no task holds all sources.
    """
    with common.scope():
        sources = common.written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "source-sizes")
        order = [F.col("source").asc_nulls_last()]
        dealt = sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        dealt = common.written(dealt.withColumn("_part", F.shiftright("_at", PARTITION_BITS)), "ranked-sources")
        parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
        starts = common.written(parts.select("_part", before.alias("_before")), "source-starts")
        place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
        weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
        ranked = dealt.join(starts, "_part").select("source", "source_size", "docs", weight.cast("double").alias("_w"), (CAP * F.col("source_size")).alias("_cap"))
        ranked = common.written(ranked, "weighed-sources")
        share, rate, capped = SHARE * (ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
        while True:
            above = F.col("_w") * rate > F.col("_cap")
            n, full, rest = ranked.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0.0))).first()
            if n == capped or not rest:
                break
            capped, rate = n, (share - full) / rest
        target = F.least(F.col("_cap"), F.col("_w") * rate)
        return common.written(ranked.select("source", "source_size", "docs", target.alias("target")), "source-targets", keep=True)


def _fold(items: str) -> Column:
    """Round a block: (open, done), the fraction left open (or null) and the rows decided with what they are rounded to.

    The open item i meets the next item j; with probability in proportion to
    the other way's words, words move from j to i, or from i to j.
    """
    i, j = "acc.open", "j"
    up, down = f"least((1 - {i}.p) * -{i}.k, {j}.p * -{j}.k)", f"least({i}.p * -{i}.k, (1 - {j}.p) * -{j}.k)"
    into_i = f"""named_struct(
        'p', IF((1 - {i}.p) * -{i}.k <= {j}.p * -{j}.k, 1D, {i}.p + {j}.p * {j}.k / {i}.k),
        'q', IF({j}.p * -{j}.k <= (1 - {i}.p) * -{i}.k, 0D, {j}.p - (1 - {i}.p) * {i}.k / {j}.k))"""
    into_j = f"""named_struct(
        'p', IF({i}.p * -{i}.k <= (1 - {j}.p) * -{j}.k, 0D, {i}.p - (1 - {j}.p) * {j}.k / {i}.k),
        'q', IF((1 - {j}.p) * -{j}.k <= {i}.p * -{i}.k, 1D, {j}.p + {i}.p * {i}.k / {j}.k))"""
    item = lambda x, p: f"named_struct('k', {x}.k, 'h', {x}.h, 'row', {x}.row, 'p', {p}, 'u', {x}.u)"
    done = lambda x, p: f"array(named_struct('row', {x}.row, 'up', CAST({p} AS INT)))"
    whole = lambda p: f"({p} <= 0 OR {p} >= 1)"
    state = f"STRUCT<open: {_ITEM}, done: ARRAY<{_DONE}>>"
    met = f"""transform(array(IF(j.u * ({up} + {down}) < {down}, {into_i}, {into_j})), t -> CAST(named_struct(
        'open', CASE WHEN {whole("t.p")} AND {whole("t.q")} THEN NULL WHEN {whole("t.p")} THEN {item(j, "t.q")} ELSE {item(i, "t.p")} END,
        'done', concat(acc.done, IF({whole("t.p")}, {done(i, "t.p")}, array()), IF({whole("t.q")}, {done(j, "t.q")}, array()))) AS {state}))[0]"""
    first = f"CAST(named_struct('open', {item(j, f'{j}.p')}, 'done', acc.done) AS {state})"
    return F.expr(f"aggregate({items}, CAST(named_struct('open', NULL, 'done', array()) AS {state}), (acc, j) -> IF(acc.open IS NULL, {first}, {met}))")


def _chance(level: int, h: Column) -> Column:
    """Uniform in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED + level), h), 11) / F.lit(float(1 << 53))


def rounded(items: DataFrame) -> DataFrame:
    """(row, up) for ``items`` (source, docs, size > 0, row, h, p strictly between 0 and 1): p rounded to 0 or 1.

    ``docs`` is the number of rows of the source, ``row`` is unique, ``h`` gives
    the order and the chance.
    """
    blocks = F.ceil(F.col("docs") / LEAF)
    open_ones = items.select("source", blocks.alias("blocks"), common.sliced(blocks, F.col("h"), seed=1).alias("block"), F.struct((-F.col("size")).alias("k"), "h", "row", "p", _chance(0, F.col("h")).alias("u")).alias("item"))
    out, level = [], 0
    while True:
        grouped = open_ones.groupBy("source", "blocks", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        folded = common.written(grouped.select("source", "blocks", "block", _fold("items").alias("s")).select("source", "blocks", "block", "s.*"), f"pivot-level{level}")
        out.append(folded.select(F.explode("done").alias("d")).select("d.*"))
        level += 1
        if (folded.agg(F.max("blocks")).first()[0] or 1) <= 1:
            break
        again = F.struct("open.k", "open.h", "open.row", "open.p", _chance(level, F.col("open.h")).alias("u"))
        open_ones = folded.filter("open IS NOT NULL").select("source", F.ceil(F.col("blocks") / BRANCH).alias("blocks"), F.floor(F.col("block") / BRANCH).alias("block"), again.alias("item"))
    last = (_chance(level, F.col("open.h")) < F.col("open.p")).cast("int")
    out.append(folded.filter("open IS NOT NULL").select("open.row", last.alias("up")))
    return common.union_all(out)


def copies(rows: DataFrame) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies) for written ``rows`` (doc_id, source, size, row with no two alike), a written table."""
    with common.scope():
        again = rows.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1")
        again = common.written(again.select("doc_id", F.lit(True).alias("_again")), "repeated-ids")
        placed = common.attach(rows, again, ["doc_id"], salt_by=["row"])
        placed = common.attach(placed, targets(rows), ["source"], salt_by=["row"])
        share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        placed = placed.withColumn("h", F.xxhash64("doc_id", F.when(F.col("_again"), F.col("row")))).withColumn("_base", F.floor(share)).withColumn("p", share - F.floor(share))
        placed = common.written(placed.drop("_again"), "mix-rows")
        items = placed.filter("size > 0 AND p > 0").select("source", "docs", "size", "row", "h", "p")
        out = placed.join(rounded(items), "row", "left")
        out = out.select("row", "doc_id", "size", "source_size", "target", (F.col("_base") + F.coalesce("up", F.lit(0))).cast("long").alias("copies"))
        return common.written(out, "mix-copies", keep=True)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of ``documents``; a null source is a source of its own, the last; null and empty texts are taken as 0 words.

    Texts of any length count whole; rows that repeat are rounded each by
    itself; an empty table gives an empty result; other columns are not read.
    """
    docs = common.numbered(common.documents(spark, sf_dir), {"doc_id": "doc_id", "source": "source", "text": "text"}, "row")
    docs = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), "row")
    return copies(common.written(docs, "mix-sizes")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@common.staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it (0 to 2 times), all columns unchanged.

    ``docs`` is read from files, twice: for its sizes, then for the rows that are
    taken. Texts without words go unless their source is taken whole; repeated
    rows are rounded each by itself; an empty table gives an empty result; no
    column name is reserved. The rows that are taken are told by bits of their
    numbers: texts are not shuffled.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = common.numbered(docs, names, "row")
    sizes = rows.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["source"]).alias("source"), n_words(F.col(names["text"])).alias("size"), "row")
    taken = copies(common.written(sizes, "mix-sizes")).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_k"))
    # A block of rows has a bit a row for those that are taken, another for those taken again.
    block, place = F.shiftright("row", BLOCK_BITS), F.col("row").bitwiseAND((1 << BLOCK_BITS) - 1)
    bits = taken.groupBy(block.alias("_block"), "_k").agg(F.bitmap_construct_agg(place).alias("_bits"))
    bits = common.written(bits.groupBy("_block").agg(F.collect_list("_bits").alias("_bits")), "mix-taken")
    byte = lambda x: F.conv(F.hex(F.substring(x, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = rows.withColumn("_block", block).join(F.broadcast(bits), "_block")  # half a KB for 1,000 rows
    out = out.withColumn("_times", F.aggregate("_bits", F.lit(0), lambda n, x: n + F.getbit(byte(x), place.bitwiseAND(7).cast("int")).cast("int")))
    out = out.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*names.values()).toDF(*docs.columns)
