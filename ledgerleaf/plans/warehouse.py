"""The stored table of processed documents that dashboards and lookups read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerleaf.operators.extract import fields_long, line_items_from_tables, with_default_items
from ledgerleaf.operators.insights import insights_long
from ledgerleaf.operators.passages import entities_long, sections_long
from ledgerleaf.operators.validate import issues_long
from ledgerleaf.plans.pipeline import DEFAULT_MIME


def store(processed: DataFrame, path: str, mode: str = "append") -> None:
    """Write processed documents, laid out by category for the document filters to prune.

    Columnar files let every reader skip the raw text it does not ask for."""
    processed.withColumn("mime_type", F.coalesce("mime_type", F.lit(DEFAULT_MIME))).write.mode(
        mode
    ).partitionBy("category").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def new_only(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents that are not stored yet."""
    return docs.join(stored.select("doc_id"), "doc_id", "left_anti")


def line_items(processed: DataFrame, page_tables: DataFrame | None = None) -> DataFrame:
    """One row per line item: those of a long table of page tables, or the nested ones."""
    if page_tables is not None:
        return with_default_items(line_items_from_tables(page_tables), processed)
    return processed.select("doc_id", F.posexplode("line_items").alias("item_ord", "item")).select(
        "doc_id", "item_ord", "item.*")


def long_tables(processed: DataFrame, page_tables: DataFrame | None = None) -> dict[str, DataFrame]:
    """One row per field, line item, section, entity, issue and insight, for analytics."""
    return {
        "line_items": line_items(processed, page_tables),
        "fields": fields_long(processed),
        "sections": sections_long(processed),
        "entities": entities_long(processed),
        "issues": issues_long(processed),
        "insights": insights_long(processed),
    }
