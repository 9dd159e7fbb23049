"""Structure of Markdown texts that are made of the documents' lines, each query with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.operators import markdown as M
from stratakit.plans.base import query, table

#: Every fifth line is a heading, every ninth opens or closes a fence, lines 2 to 4 of a text are a table.
_LINE = "CASE WHEN nr % 9 = 8 THEN '```' WHEN nr = 2 THEN '| a | b \\| c |' WHEN nr = 3 THEN '|---|:-:|' WHEN nr = 4 THEN '| 1 | 2 |' WHEN nr % 5 = 0 THEN repeat('#', nr::INT % 3 + 1) || ' ' || CASE WHEN nr % 10 = 0 THEN 'The  Part' ELSE 'Part ' || nr END ELSE line END"
_MD_SQL = f"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nr FROM documents),
md AS (SELECT doc_id, nr, {_LINE} AS line FROM raw), fen AS (SELECT *, sum((line = '```')::INT) OVER (PARTITION BY doc_id ORDER BY nr) % 2 = 1 OR line = '```' AS fenced, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY nr) - len(line) - 1 AS start FROM md),
heads AS (SELECT doc_id, nr, start, len(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\\s+(.*)$', 1)) AS title FROM fen WHERE NOT fenced AND regexp_matches(line, '^#{{1,6}}\\s'))"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nr", "line"))
    title = F.when(F.col("nr") % 10 == 0, "The  Part").otherwise(F.concat(F.lit("Part "), F.col("nr").cast("string")))
    made = (
        F.when(F.col("nr") % 9 == 8, "```").when(F.col("nr") == 2, "| a | b \\| c |").when(F.col("nr") == 3, "|---|:-:|").when(F.col("nr") == 4, "| 1 | 2 |")
        .when(F.col("nr") % 5 == 0, F.concat(F.repeat(F.lit("#"), F.col("nr") % 3 + 1), F.lit(" "), title)).otherwise(F.col("line"))
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("nr", made.alias("l")))), lambda x: x["l"])
    return each.groupBy("doc_id").agg(F.array_join(rows, "\n").alias("text"))


@query(f"WITH {_MD_SQL} SELECT doc_id, nr, start, level, title FROM heads")
def text_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.headings(M.lines(_markdown(spark, sf_dir))).select("doc_id", F.col("nr").cast("long").alias("nr"), "start", F.col("level").cast("long").alias("level"), "title")


@query(f"WITH {_MD_SQL}, own AS (SELECT doc_id, min(nr) AS at_line, arg_min(level, nr) AS level FROM heads WHERE title = 'The  Part' GROUP BY doc_id) SELECT o.doc_id, at_line + 1 AS first, min(h.nr) - 1 AS last FROM own o LEFT JOIN heads h ON h.doc_id = o.doc_id AND h.nr > at_line AND h.level <= o.level GROUP BY o.doc_id, at_line")
def text_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.section(M.lines(_markdown(spark, sf_dir)), "the part")
    return out.select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"WITH {_MD_SQL}, n AS (SELECT doc_id, count(*) AS n FROM md GROUP BY doc_id) SELECT doc_id, 2 AS nr, ['a', 'b | c'] AS header, CASE WHEN n > 4 THEN 1 ELSE 0 END AS n_rows FROM n WHERE n > 3")
def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables with their header; an escaped bar is part of a cell."""
    return M.tables(M.lines(_markdown(spark, sf_dir))).filter("nr = 2").select("doc_id", F.col("nr").cast("long").alias("nr"), "header", "n_rows")


@query()
def text_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that follow a text's structure; a scan by regular expressions has no SQL twin."""
    out = M.passages(_markdown(spark, sf_dir))
    return out.select("doc_id", "seq", "kind", "heading", "start", "end", F.md5("text").alias("hash"))
