"""Insights per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.text import contains_any, fill
from ledgerleaf.functions.values import money, parse_num
from ledgerleaf.operators.validate import field_value, field_values
from ledgerleaf.rules import insights as R
from ledgerleaf.rules.fields import FIELDS


def _insight(rule: R.Insight, wording: dict[str, Column]) -> Column:
    return F.struct(
        F.lit(rule.type).alias("type"),
        F.lit(rule.badge).alias("badge"),
        F.lit(rule.icon).alias("icon"),
        fill(rule.title, **wording).alias("title"),
        fill(rule.description, **wording).alias("description"),
        F.lit(rule.action).alias("action"),
    )


def add_insights(validated: DataFrame, saving: str = "reference") -> DataFrame:
    """Add ``insights``.

    saving='reference' states the fixed amount of the reference texts;
    saving='computed' states 2 % of the document's own total.
    """
    status = F.col("validation_status")
    holds = {
        "always": F.lit(True),
        "valid": status == "valid",
        "not_valid": status != "valid",
        "flagged": status.isin("warning", "error"),
        "law_not_specified": contains_any(F.lower(field_value("governing_law")), ("not specified",)),
    }
    wording = {key: field_value(key, absent) for key, absent in R.ABSENT.items()}
    wording["saving"] = (
        F.lit(R.STATED_SAVING) if saving == "reference"
        else money(parse_num(field_value("grand_total", "0")) * R.SAVING_RATE)
    )
    category = F.col("category")
    entries = F.array(*(
        F.when(
            (~category.isin(*FIELDS) if rule.category is None else category == rule.category)
            & holds[rule.when],
            _insight(rule, wording),
        )
        for rule in R.INSIGHTS
    ))
    kept = [name for name in validated.columns if name != "insights"]
    return (
        validated.withColumn("field_values", field_values())
        .withColumn("insights", F.array_compact(entries))
        .select(*kept, "insights")
    )


def insights_long(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "category", F.posexplode("insights").alias("insight_ord", "i")
    ).select("doc_id", "category", "insight_ord", "i.*")
