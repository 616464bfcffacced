"""The whole dataflow over a DataFrame of documents, batch or streaming."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.text import strip_cheaply
from ledgerleaf.operators.classify import candidates, classify
from ledgerleaf.operators.extract import extract_fields
from ledgerleaf.operators.insights import add_insights
from ledgerleaf.operators.passages import extract_entities, extract_sections
from ledgerleaf.operators.validate import settled_line_totals, validate, with_line_totals, with_summed_lines
from ledgerleaf.rules.audit import REFERENCE_AS_OF

# Accepted extensions; text that stands in for a document without any.
EXTENSIONS = (".pdf", ".txt", ".png", ".jpg", ".jpeg")
EMPTY_TEXT = ("Scanned/Image document: ", "\nVisual OCR processed.")
DEFAULT_MIME = "application/pdf"


def extension(name: Column) -> Column:
    """The last suffix of the file name, lower case; a leading dot starts a name, not a suffix."""
    return F.lower(F.regexp_extract(name, r"[^./][^/]*?(\.[^./]*)\z", 1))


def accepted(docs: DataFrame) -> DataFrame:
    return docs.where(extension(F.col("original_name")).isin(*EXTENSIONS))


def rejected(docs: DataFrame) -> DataFrame:
    return docs.where(~extension(F.col("original_name")).isin(*EXTENSIONS))


def fill_empty_text(docs: DataFrame) -> DataFrame:
    """Strip the text; a document without any gets a line that says so."""
    stripped = strip_cheaply(F.col("text"))
    before, after = EMPTY_TEXT
    return docs.withColumn(
        "text",
        F.when(stripped == "", F.concat(F.lit(before), F.col("original_name"), F.lit(after)))
        .otherwise(stripped),
    )


def prepare(docs: DataFrame) -> DataFrame:
    """Keep page 1 as it came, for the vendor heading, and strip or fill the text."""
    first_page = (
        F.get(F.col("pages"), F.lit(0))["text"] if "pages" in docs.columns else F.col("text")
    )
    return fill_empty_text(docs.withColumn("first_page", first_page))


def understand(docs: DataFrame, defaults: str = "reference", keys: Collection[str] | None = None, category: str | None = None) -> DataFrame:
    """Classify and extract fields, those of `keys` or all; with `category`, of its documents alone."""
    if category is None:
        return extract_fields(classify(prepare(docs)), defaults, keys)
    of_category = classify(candidates(prepare(docs), category)).where(F.col("category") == category)
    return extract_fields(of_category, defaults, keys)


def audit(
    docs: DataFrame,
    page_tables: DataFrame | None = None,
    defaults: str = "reference",
    as_of: str = REFERENCE_AS_OF,
) -> DataFrame:
    """Classify, extract, validate. With page tables in a long table the texts stay out of the
    join: the line totals are joined to the slim rows only."""
    slim = understand(docs, defaults).drop("text", "first_page")
    return validate(with_line_totals(slim, page_tables, defaults), as_of)


def process(
    docs: DataFrame,
    page_tables: DataFrame | None = None,
    defaults: str = "reference",
    as_of: str = REFERENCE_AS_OF,
    saving: str = "reference",
    caps: str | None = "reference",
) -> DataFrame:
    """Everything the reference stores for a document, one row each.

    Documents carry doc_id, original_name, text and optionally nested pages; every step but the
    join with a long table of page tables works per row and needs no shuffle.
    """
    # The line sums meet the texts before the text work: what is read from a text takes several times its room in a shuffle.
    whole = docs if page_tables is None else with_summed_lines(docs, page_tables)
    read = extract_entities(extract_sections(understand(whole, defaults), caps), caps).drop("first_page")
    totals = with_line_totals(read, None, defaults) if page_tables is None else settled_line_totals(read, defaults)
    return add_insights(validate(totals, as_of), saving)
