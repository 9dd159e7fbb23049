"""Markdown texts as lines, headings, sections, tables and passages that follow their structure."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the passages: characters aimed at, the fewest that stand alone, the most of a paragraph, and the windows a longer one is cut into.
TARGET, FEWEST, MOST, WINDOW, OVERLAP, CODE = 1200, 300, 2000, 1000, 150, 200
HEADING = r"^#{1,6}\s+(.*?)\s*#*$"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, nr, start, line, fenced): each line with its offset and whether it lies in a code fence, the fence's own lines included."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("nr", "line"))
    w = Window.partitionBy("doc_id").orderBy("nr")
    fence = F.ltrim("line").startswith("```") | F.ltrim("line").startswith("~~~")
    marks = F.sum(fence.cast("int")).over(w)
    start = F.sum(F.length("line") + 1).over(w) - F.length("line") - 1
    return each.withColumn("start", start).withColumn("fenced", (marks % 2 == 1) | fence)


def headings(text_lines: DataFrame) -> DataFrame:
    """(doc_id, nr, start, level, title) of headings outside fences; ``text_lines`` from ``lines``."""
    held = text_lines.filter(~F.col("fenced") & F.col("line").rlike(HEADING))
    return held.select("doc_id", "nr", "start", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.regexp_extract("line", HEADING, 1).alias("title"))


def section(text_lines: DataFrame, title: str) -> DataFrame:
    """(doc_id, first, last): lines of the body of the first section with a title, any case and spacing, up to the next heading of its level or above; ``last`` null at a text's end."""
    heads = headings(text_lines)
    folded = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    own = heads.filter(folded == " ".join(title.split()).lower()).groupBy("doc_id").agg(F.min(F.struct("nr", "level")).alias("h")).select("doc_id", F.col("h.nr").alias("_at"), F.col("h.level").alias("_level"))
    after = own.join(heads.select("doc_id", "nr", "level"), "doc_id", "left").filter("nr > _at AND level <= _level").groupBy("doc_id").agg(F.min("nr").alias("_end"))
    return own.join(after, "doc_id", "left").select("doc_id", (F.col("_at") + 1).alias("first"), (F.col("_end") - 1).alias("last"))


def cells(row: Column) -> Column:
    """The cells of a pipe table's row; an escaped bar is part of its cell."""
    bare = F.regexp_replace(F.trim(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def tables(text_lines: DataFrame) -> DataFrame:
    """(doc_id, nr, header, n_rows): pipe tables outside fences, a header line above a line of dashes, and how many rows follow without a gap."""
    piped = F.trim("line").startswith("|") & ~F.col("fenced")
    w = Window.partitionBy("doc_id").orderBy("nr")
    runs = text_lines.filter(piped).withColumn("_run", F.col("nr") - F.row_number().over(w))
    held = runs.groupBy("doc_id", "_run").agg(F.min("nr").alias("nr"), F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("nr", "line"))).alias("_l"))
    second = F.get(F.col("_l.line"), F.lit(1))
    return held.filter(second.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*$")).select("doc_id", "nr", cells(F.get(F.col("_l.line"), F.lit(0))).alias("header"), (F.col("_n") - 2).alias("n_rows"))


_KINDS = (
    ("code", re.compile(r"(?ms)^(```|~~~).*?^\1[ \t]*$")),
    ("table", re.compile(r"(?m)^\|.*\n\|[ \t:|-]*-[ \t:|-]*(?:\n\|.*)*")),
    ("formula", re.compile(r"(?ms)^\$\$.+?\$\$[^\n]*$")),
    ("heading", re.compile(r"(?m)^#{1,6}[ \t]+\S.*$")),
    ("page", re.compile(r"(?m)^<!-- page \d+ -->[ \t]*$")),
    ("figure", re.compile(r"(?m)^(?:Figure|Fig\.) \d+.*(?:\n(?!\s*$|#|\|).*)*")),
    ("text", re.compile(r"(?m)^(?!\s*$).*(?:\n(?!\s*$|#{1,6}[ \t]|\||```|~~~|\$\$|<!-- page ).*)*")),
)
_REFERENCES = re.compile(r"(?i)^(references|bibliography|literatur(verzeichnis)?|bibliographie)$")


def elements(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of a text's blocks in order; what starts at a line belongs to the first kind that fits there."""
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        found = next(((kind, m) for kind, pattern in _KINDS if (m := pattern.match(text, at))), None)
        if found is None or found[1].end() == at:
            at = end + 1
            continue
        yield found[0], at, found[1].end()
        at = found[1].end() + 1


def passages_of(text: str) -> Iterator[tuple[str, str, int | None, int, int]]:
    """(kind, heading path, page, start, end): tables, code, formulas, figures and references each by itself, paragraphs under one heading together up to ``TARGET``."""
    path: list[tuple[int, str]] = []
    page, held = None, []
    out: list[tuple[str, str, int | None, int, int]] = []
    name = lambda: " / ".join(t for _, t in path)

    def put() -> None:
        if held:
            start, end = held[0][0], held[-1][1]
            last = out[-1] if out else None
            if end - start < FEWEST and last and last[0] == "text" and last[1:3] == (name(), page) and end - last[3] <= MOST:
                out[-1] = (*last[:4], end)
            else:
                out.append(("text", name(), page, start, end))
            held.clear()

    for kind, start, end in elements(text):
        if kind == "code" and end - start < CODE:
            kind = "text"
        if kind == "text" and path and _REFERENCES.match(path[-1][1]):
            kind = "reference"
        if kind == "text" and end - start > MOST:
            put()
            for a in range(start, max(start + 1, end - OVERLAP), WINDOW - OVERLAP):
                out.append(("text", name(), page, a, min(a + WINDOW, end)))
        elif kind == "text":
            if held and end - held[0][0] > TARGET:
                put()
            held.append((start, end))
        else:
            put()
            if kind == "heading":
                line = text[start:end]
                level = len(line) - len(line.lstrip("#"))
                path = [*[p for p in path if p[0] < level], (level, line.strip("# \t"))]
            elif kind == "page":
                page = int(re.search(r"\d+", text[start:end])[0])
            else:
                out.append((kind, name(), page, start, end))
    put()
    return iter(out)


PASSAGES = pa.schema([("seq", pa.int64()), ("kind", pa.string()), ("heading", pa.string()), ("page", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, heading, page, start, end, text) of every text; ``text`` is what stands between the two offsets. Null and empty texts have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for seq, (kind, heading, page, start, end) in enumerate(passages_of(text or "")):
                    ids.append(doc_id)
                    rows.append((seq, kind, heading, page, start, end, text[start:end]))
            columns = zip(*rows, strict=True) if rows else [[] for _ in PASSAGES]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, PASSAGES, strict=True)]], names=["doc_id", *PASSAGES.names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(read, "doc_id long, seq long, kind string, heading string, page long, start long, `end` long, text string")
