"""Dashboard and portfolio figures over processed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerleaf.functions.values import parse_date, percent, round_exact

# Shown rows, skipped names, deadline keys in report order, stand-in confidence.
RECENT, TOP_VENDORS, TOP_RISKS, TOP_DEADLINES = 6, 6, 5, 6
NO_NAME = ("", "N/A", "None")
COUNTERPARTY_KEYS = ("vendor_name", "party_two")
DEADLINE_KEYS = ("due_date", "expiration_date", "corrective_deadline", "expiry_date")
NO_CONFIDENCE = 0.95


def newest_first():
    """Equal times are told apart by id."""
    return [F.desc("created_at"), F.desc("doc_id")]


def dashboard_kpis(docs: DataFrame) -> DataFrame:
    """Counts by status and mean confidence in one pass. Confidences are summed as decimals, so
    the mean does not depend on the partitioning."""
    status = F.col("validation_status")
    confidence = F.col("category_confidence").cast("decimal(10,4)")
    counted = docs.agg(
        F.count("*").alias("total_documents"),
        F.count_if(status == "valid").alias("valid_documents"),
        F.count_if(status.isin("warning", "needs_review")).alias("needs_review"),
        F.count_if(status == "error").alias("high_risk_errors"),
        F.sum(confidence).cast("double").alias("confidence_sum"),
        F.count("category_confidence").alias("confidences"),
    )
    mean = F.try_divide(F.col("confidence_sum"), F.col("confidences"))
    known = F.coalesce(F.nullif(mean, F.lit(0.0)), F.lit(NO_CONFIDENCE))
    return counted.withColumn("average_confidence", round_exact(known * 100, 1)).drop(
        "confidence_sum", "confidences"
    )


def category_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(F.count("*").alias("documents"))


def category_share(docs: DataFrame) -> DataFrame:
    """Whole percent per category, halves up. The total is taken over the counts, a row for each
    of the few categories, so the documents are read once."""
    total = F.sum("documents").over(Window.partitionBy())
    share = F.floor(F.col("documents") / total * 100 + 0.5)
    return category_counts(docs).withColumn("percent", share.cast("long"))


def total_anomalies(docs: DataFrame) -> DataFrame:
    return docs.agg(F.sum(F.size("issues")).cast("long").alias("total_anomalies"))


def recent_documents(docs: DataFrame, limit: int = RECENT) -> DataFrame:
    return docs.orderBy(*newest_first()).limit(limit).select(
        "doc_id",
        F.col("original_name").alias("title"),
        "category",
        F.col("validation_status").alias("status"),
        percent(F.col("category_confidence")).alias("confidence"),
        F.col("created_at").alias("timestamp"),
    )


def counterparty() -> Column:
    """Who the other side of a document is, if any field says so."""
    def value(key: str):
        held = F.filter("fields", lambda f: f["key"] == key)
        return F.nullif(F.get(held, F.lit(0))["value"], F.lit(""))

    return F.coalesce(*map(value, COUNTERPARTY_KEYS))


def vendor_frequency(docs: DataFrame) -> DataFrame:
    """Documents per counterparty, with the newest document that names it."""
    # One counterparty per document comes out of a generator: the name filter below stays above
    # the extraction instead of repeating it.
    named = docs.select(
        "doc_id", "created_at",
        F.explode(F.array(counterparty())).alias("name"),
    )
    return (
        named.where(F.col("name").isNotNull() & ~F.col("name").isin(*NO_NAME))
        .groupBy("name")
        .agg(
            F.count("*").alias("frequency"),
            F.max(F.struct("created_at", "doc_id")).alias("newest"),
        )
    )


def top_vendors(docs: DataFrame, limit: int = TOP_VENDORS) -> DataFrame:
    """Most frequent counterparties; of equal ones the first in recency order."""
    return (
        vendor_frequency(docs)
        .orderBy(F.desc("frequency"), F.desc("newest"))
        .limit(limit)
        .select("name", "frequency")
    )


def urgent_risks(docs: DataFrame, limit: int = TOP_RISKS) -> DataFrame:
    """First error issues in recency order, then issue order."""
    errors = docs.select(
        "doc_id", "created_at", "original_name",
        F.posexplode("issues").alias("issue_ord", "i"),
    ).where(F.col("i.severity") == "error")
    return (
        errors.orderBy(*newest_first(), "issue_ord").limit(limit)
        .select(
            "doc_id", F.col("original_name").alias("doc_title"),
            F.col("i.title").alias("issue"), F.col("i.message").alias("message"),
        )
    )


def deadlines(docs: DataFrame, limit: int = TOP_DEADLINES, by_date: bool = False) -> DataFrame:
    """First deadlines in recency order, then key order; by_date=True sorts by the date instead."""
    keys = F.array(*(F.lit(k) for k in DEADLINE_KEYS))
    rows = docs.select(
        "doc_id", "created_at", "original_name",
        F.explode(
            F.filter("fields", lambda f: f["key"].isin(*DEADLINE_KEYS))
        ).alias("f"),
    ).withColumn("key_ord", F.array_position(keys, F.col("f.key")))
    order = [*newest_first(), F.asc("key_ord")]
    if by_date:
        order = [parse_date(F.col("f.value")).asc_nulls_last(), *order]
    return rows.orderBy(*order).limit(limit).select(
        "doc_id", F.col("original_name").alias("doc_title"),
        F.col("f.label").alias("label"), F.col("f.value").alias("date"),
    )
