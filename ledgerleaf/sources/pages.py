"""Assembling documents from pages and taking them apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.offsets import last_upto, with_running_sums
from ledgerleaf.functions.stages import evaluated
from ledgerleaf.functions.text import strip

# Fixed value: what stands before each page in the assembled text.
MARKER = "\n--- Page {n} ---\n"
_MARKER_PATTERN = r"(?:\A|\n)--- Page (\d+) ---\n"
PAGES_PER_PART = 1000


def _marked(page):
    before, after = MARKER.split("{n}")
    return F.concat(
        F.lit(before), page["page_number"].cast("string"), F.lit(after),
        F.coalesce(page["text"], F.lit("")),
    )


def assemble(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Text of each document from its pages, in page order, with a marker before every page:
    doc_id, page_count, text. One row per document, whatever its length.

    Pages are first joined to parts, cut by page number, then parts to the text, so the sorting of a
    long document is spread over tasks; only the few joined parts meet.
    """
    part = F.floor((F.col("page_number") - 1) / pages_per_part).cast("int")
    parts = (
        pages.withColumn("part_no", part)
        .groupBy("doc_id", "part_no")
        .agg(
            F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("page_rows"),
            F.count("*").alias("part_pages"),
        )
        .select(
            "doc_id", "part_no", "part_pages",
            F.array_join(F.transform("page_rows", _marked), "").alias("text"),
        )
    )
    joined = parts.groupBy("doc_id").agg(
        F.sum("part_pages").alias("page_count"),
        F.sort_array(F.collect_list(F.struct("part_no", "text"))).alias("parts"),
    )
    return joined.select(
        "doc_id", "page_count", strip(F.array_join(F.col("parts")["text"], "")).alias("text"))


def split_pages(docs: DataFrame) -> DataFrame:
    """Pages of an assembled text (doc_id, page_number, text): the inverse of assemble."""
    numbers = F.regexp_extract_all("text", F.lit(_MARKER_PATTERN), 1)
    texts = F.split("text", _MARKER_PATTERN, -1)
    pairs = F.arrays_zip(
        numbers.alias("n"), F.slice(texts, 2, F.size(texts)).alias("t")
    )
    return docs.select("doc_id", F.explode(pairs).alias("p")).select(
        "doc_id", F.col("p.n").cast("int").alias("page_number"), F.col("p.t").alias("text")
    )


def with_page_starts(docs: DataFrame) -> DataFrame:
    """Add to assembled texts `page_starts` and `page_numbers`: where the text of each page begins, in code points, and its number."""
    rows = evaluated(docs, _marks=F.regexp_extract_all("text", F.lit(_MARKER_PATTERN), 0), page_numbers=F.regexp_extract_all("text", F.lit(_MARKER_PATTERN), 1).cast("array<int>"),
                     _gaps=F.split("text", _MARKER_PATTERN, -1))
    rows = evaluated(rows, _steps=F.transform("_marks", lambda mark, k: F.length(mark) + F.length(F.get("_gaps", k))))
    return with_running_sums(rows, "_steps", "page_starts").drop("_marks", "_gaps", "_steps")


def page_at(offset) -> Column:
    """The page that holds a code point of an assembled text with page starts; null before the first page."""
    return F.get("page_numbers", last_upto(F.col("page_starts"), offset))


def page_count(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages per document; 1 for a document that came without pages."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("pages", F.lit(1)).cast("long").alias("page_count")
    )
