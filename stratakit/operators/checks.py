"""Data-quality checks by name: each takes the tables of a library and returns the ids of bad rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakit.functions import text as T
from stratakit.operators import knowledge as K


@dataclass
class Tables:
    """``entities`` (id, name, type), ``edges`` (id, src, rel, dst, source_doc, producer, valid_to), ``documents`` (doc_id, text, mime, pages, n_chars, stamp, retired), ``vectors`` (doc_id), ``reviews`` (id, doc_id), ``jobs`` (id, beat, now)."""

    entities: DataFrame
    edges: DataFrame
    documents: DataFrame
    vectors: DataFrame
    reviews: DataFrame
    jobs: DataFrame


Check = Callable[[Tables], DataFrame]
CHECKS: dict[str, Check] = {}
#: Relations with one answer, the current version of the readers, and seconds after which a job is taken for dead.
FUNCTIONAL, VERSION, DEAD_AFTER = ("located_in", "part_of"), 5, 3600


def check(name: str) -> Callable[[Check], Check]:
    def register(f: Check) -> Check:
        CHECKS[name] = f
        return f

    return register


def _live(t: Tables) -> DataFrame:
    return t.edges.filter("valid_to IS NULL")


def _docs(t: Tables) -> DataFrame:
    return t.documents.filter("NOT retired")


def _named(t: Tables, pattern: str) -> DataFrame:
    return t.entities.filter(F.col("name").rlike(pattern)).select("id")


@check("functional-conflicts")
def functional_conflicts(t: Tables) -> DataFrame:
    """Subjects with several live answers of a relation that has one."""
    held = _live(t).filter(F.col("rel").isin(*FUNCTIONAL)).groupBy("src", "rel").agg(F.count_distinct("dst").alias("_n"))
    return held.filter("_n > 1").select(F.col("src").alias("id")).distinct()


@check("self-edges")
def self_edges(t: Tables) -> DataFrame:
    return _live(t).filter("src = dst").select("id")


@check("duplicate-facts")
def duplicate_facts(t: Tables) -> DataFrame:
    return K.same_facts(t.edges).select("id")


@check("placeholder-entities")
def placeholder_entities(t: Tables) -> DataFrame:
    return _named(t, r"(?i)^(unknown|none|n/?a|tbd|anonymous|untitled|customer#0+)$")


@check("reference-number-entities")
def reference_number_entities(t: Tables) -> DataFrame:
    return _named(t, r"^\[?[0-9]{1,4}\]?$|#0*[0-9]{2}$")


@check("mangled-names")
def mangled_names(t: Tables) -> DataFrame:
    """Control characters, replacement marks or white space in a row."""
    return _named(t, r"[\x00-\x1f\x{FFFD}]|\s\s")


@check("unnamed-entities")
def unnamed_entities(t: Tables) -> DataFrame:
    return t.entities.filter(F.col("name").isNull() | (F.trim("name") == "")).select("id")


@check("split-names")
def split_names(t: Tables) -> DataFrame:
    """Names that entities of several types share, by the first of them."""
    held = t.entities.groupBy(F.lower("name")).agg(F.count_distinct("type").alias("_n"), F.min("id").alias("id"))
    return held.filter("_n > 1").select("id")


@check("spacing-twins")
def spacing_twins(t: Tables) -> DataFrame:
    return K.spacing_twins(t.entities).select(F.col("first").alias("id"))


@check("edges-of-retired-documents")
def edges_of_retired_documents(t: Tables) -> DataFrame:
    gone = t.documents.filter("retired").select(F.col("doc_id").alias("source_doc"))
    return _live(t).join(gone, "source_doc", "left_semi").select("id")


@check("review-of-retired-documents")
def review_of_retired_documents(t: Tables) -> DataFrame:
    return t.reviews.join(t.documents.filter("retired").select("doc_id"), "doc_id", "left_semi").select("id")


@check("stale-jobs")
def stale_jobs(t: Tables) -> DataFrame:
    return t.jobs.filter(F.col("beat") < F.col("now") - DEAD_AFTER).select("id")


@check("twin-documents")
def twin_documents(t: Tables) -> DataFrame:
    """Live documents of one text, by the first of them."""
    held = _docs(t).groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("id"), F.count("*").alias("_n"))
    return held.filter("_n > 1").select("id")


@check("untyped-documents")
def untyped_documents(t: Tables) -> DataFrame:
    return _docs(t).filter(F.col("mime").isNull() | (F.col("mime") == "application/octet-stream")).select(F.col("doc_id").alias("id"))


@check("uncounted-pages")
def uncounted_pages(t: Tables) -> DataFrame:
    return _docs(t).filter((F.col("mime") == "application/pdf") & (F.coalesce("pages", F.lit(0)) == 0)).select(F.col("doc_id").alias("id"))


@check("thin-texts")
def thin_texts(t: Tables) -> DataFrame:
    return _docs(t).filter((F.col("mime") == "application/pdf") & (F.col("pages") >= 5) & (F.col("n_chars") / F.col("pages") < 100)).select(F.col("doc_id").alias("id"))


@check("unreadable-documents")
def unreadable_documents(t: Tables) -> DataFrame:
    """Fewer letters than half of what is not white space."""
    letters, signs = F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.length(F.regexp_replace("text", r"\s", ""))
    return _docs(t).filter((signs > 0) & (2 * letters < signs)).select(F.col("doc_id").alias("id"))


@check("stale-extractions")
def stale_extractions(t: Tables) -> DataFrame:
    return _docs(t).filter(F.col("stamp") < VERSION).select(F.col("doc_id").alias("id"))


@check("documents-without-an-extractor")
def documents_without_an_extractor(t: Tables) -> DataFrame:
    return _docs(t).filter(F.col("stamp").isNull() & F.col("mime").startswith("video/")).select(F.col("doc_id").alias("id"))


@check("chunks-without-vectors")
def chunks_without_vectors(t: Tables) -> DataFrame:
    return _docs(t).filter(F.length("text") > 0).join(t.vectors.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


@check("unmapped-glyphs")
def unmapped_glyphs(t: Tables) -> DataFrame:
    """Private-use characters or replacement marks in a text."""
    return _docs(t).filter(F.col("text").rlike(r"[\x{E000}-\x{F8FF}\x{FFFD}]")).select(F.col("doc_id").alias("id"))


@check("wire-names")
def wire_names(t: Tables) -> DataFrame:
    """Names that hold a separator of the line format."""
    return _named(t, r"[\t|]")


@check("damaged-names")
def damaged_names(t: Tables) -> DataFrame:
    """UTF-8 read as Latin-1."""
    return _named(t, r"Ã.|â€")


@check("document-twins")
def document_twins(t: Tables) -> DataFrame:
    """Entities of one type whose normal names are equal, by the first of them."""
    held = t.entities.groupBy("type", T.normal_name(F.col("name"))).agg(F.min("id").alias("id"), F.count("*").alias("_n"))
    return held.filter("_n > 1").select("id")


def findings(tables: Tables, names: list[str] | None = None) -> DataFrame:
    """(check, id) of every bad row that the checks find."""
    frames = [CHECKS[n](tables).select(F.lit(n).alias("check"), F.col("id").cast("long").alias("id")) for n in names or CHECKS]
    return reduce(DataFrame.unionByName, frames)
