"""Document filters and lookups. An empty or 'all' value means no filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# What each status tab shows.
STATUS_TABS = {
    "valid": ("valid",), "warning": ("warning", "needs_review"), "error": ("error",),
}


def _equals(docs: DataFrame, column: str, value: str | None) -> DataFrame:
    if not value or value.lower() == "all":
        return docs
    return docs.where(F.lower(column) == value.lower())


def filter_category(docs: DataFrame, category: str | None) -> DataFrame:
    return _equals(docs, "category", category)


def filter_status(docs: DataFrame, status: str | None) -> DataFrame:
    return _equals(docs, "validation_status", status)


def status_tab(docs: DataFrame, tab: str = "all") -> DataFrame:
    if tab not in STATUS_TABS:
        return docs
    return docs.where(F.col("validation_status").isin(*STATUS_TABS[tab]))


def search(docs: DataFrame, text: str | None, columns=("original_name", "category")) -> DataFrame:
    """Plain substring in any of the columns, ignoring case."""
    if not text:
        return docs
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.contains(F.lower(column), F.lit(text.lower()))
    return docs.where(hit)


def search_wide(docs: DataFrame, text: str | None) -> DataFrame:
    """Search that trims its text and looks at the status too."""
    return search(
        docs, (text or "").strip(), ("original_name", "category", "validation_status")
    )


def filter_user(docs: DataFrame, user_id: int | None) -> DataFrame:
    return docs.where(F.col("user_id") == user_id) if user_id else docs


def with_intelligence(docs: DataFrame, intelligence: DataFrame) -> DataFrame:
    """Every document, with what is known about it; unknown lists become empty ones."""
    joined = docs.join(intelligence, "doc_id", "left")
    empties = {
        field.name: F.coalesce(F.col(field.name), F.array().cast(field.dataType))
        for field in intelligence.schema.fields
        if field.dataType.typeName() == "array"
    }
    return joined.withColumns(empties)


def by_id(docs: DataFrame, intelligence: DataFrame, doc_id: int) -> DataFrame:
    """One document in full; both sides are filtered before they meet."""
    key = F.col("doc_id") == doc_id
    return with_intelligence(docs.where(key), intelligence.where(key))


def known(requests: DataFrame, docs: DataFrame) -> DataFrame:
    return requests.join(docs.select("doc_id"), "doc_id", "left_semi")


def unknown(requests: DataFrame, docs: DataFrame) -> DataFrame:
    return requests.join(docs.select("doc_id"), "doc_id", "left_anti")


def newest_first(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("created_at"), F.desc("doc_id"))


