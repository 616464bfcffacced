"""Rule-based validation: issues, score and status."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.stages import evaluated
from ledgerleaf.functions.text import contains_any, fill, strip
from ledgerleaf.functions.values import money, parse_date, parse_num, percent, plain_number, round_exact
from ledgerleaf.operators.extract import ITEM_TYPE, default_line_items, line_items_from_tables, page_line_items
from ledgerleaf.rules import audit as R
from ledgerleaf.rules.categories import AUDIT, CONTRACT, IDENTITY, INVOICE
from ledgerleaf.rules.fields import DEFAULT_LINE_ITEMS

DEFAULT_LINE_SUM = sum(float(item[-1].replace(",", "")) for item in DEFAULT_LINE_ITEMS)
ISSUE_TYPE = (
    "struct<severity:string,field:string,title:string,message:string,code:string,penalty:int>"
)


def field_values() -> Column:
    """Key to value, for lookups by rule."""
    return F.map_from_entries(
        F.transform("fields", lambda f: F.struct(f["key"], f["value"]))
    )


def field_value(key: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(F.col("field_values"), F.lit(key)), F.lit(default))


def line_totals(items: DataFrame) -> DataFrame:
    """Line count and sum per document. Sums of decimals do not depend on the row order, and the
    partial sums are taken before the shuffle, so a document with very many lines is no hot spot.

    No decimal holds all amounts: those below 10 ** 15 are summed with six places, those below 10 ** 30 without,
    what is above as doubles, whose sum may differ in its last bit with the order."""
    amount = parse_num(F.col("total"))

    def band(low: float, high: float, kind: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("amount") >= low) & (F.col("amount") < high), F.col("amount")).cast(kind)).cast("double"), F.lit(0.0))

    return items.select("doc_id", amount.alias("amount")).groupBy("doc_id").agg(
        F.count("*").alias("line_count"),
        (band(float("-inf"), 1e15, "decimal(28,6)") + band(1e15, 1e30, "decimal(38,0)")
         + F.coalesce(F.sum(F.when(F.col("amount") >= 1e30, F.col("amount"))), F.lit(0.0))).alias("line_sum"),
    )


def line_totals_nested(items: Column) -> tuple[Column, Column]:
    total = F.aggregate(
        items, F.lit(0.0), lambda acc, item: acc + parse_num(item["total"])
    )
    return F.size(items).cast("long"), total


def with_line_totals(
    docs: DataFrame, page_tables: DataFrame | None = None, defaults: str = "reference"
) -> DataFrame:
    """Add line_count and line_sum, from a long table of page tables, or from nested ``pages``
    along with the items themselves as ``line_items``.

    Only invoices have line items; without any they get the default ones ('reference') or none.
    """
    invoice = F.col("category") == INVOICE
    if page_tables is not None:
        return settled_line_totals(with_summed_lines(docs, page_tables), defaults)
    none = F.array().cast(f"array<{ITEM_TYPE}>")
    shown = default_line_items() if defaults == "reference" else none
    if "pages" not in docs.columns:
        count, total = (len(DEFAULT_LINE_ITEMS), DEFAULT_LINE_SUM) if defaults == "reference" else (0, 0.0)
        return docs.withColumns({
            "line_items": F.when(invoice, shown).otherwise(none),
            "line_count": F.when(invoice, count).otherwise(0).cast("long"),
            "line_sum": F.when(invoice, total).otherwise(0.0),
        })
    found = evaluated(docs, _items=F.when(invoice, page_line_items(F.col("pages"))))
    items = F.when(~invoice, none).when(F.size("_items") > 0, F.col("_items")).otherwise(shown)
    docs = evaluated(found, line_items=items).drop("_items")
    count, total = line_totals_nested(F.col("line_items"))
    return evaluated(docs, line_count=count, line_sum=total)


def with_summed_lines(docs: DataFrame, page_tables: DataFrame) -> DataFrame:
    """Add what a long table of page tables says of line_count and line_sum; needs no category yet."""
    return docs.join(line_totals(line_items_from_tables(page_tables)), "doc_id", "left")


def settled_line_totals(docs: DataFrame, defaults: str = "reference") -> DataFrame:
    """Line totals of the summed lines: of invoices only, the default ones where there are none."""
    invoice = F.col("category") == INVOICE
    empty = F.coalesce(F.col("line_count"), F.lit(0)) == 0
    if defaults == "reference":
        count, total = F.lit(len(DEFAULT_LINE_ITEMS)), F.lit(DEFAULT_LINE_SUM)
    else:
        count, total = F.lit(0), F.lit(0.0)
    return docs.withColumns({
        "line_count": F.when(~invoice, 0).when(empty, count)
        .otherwise(F.col("line_count")).cast("long"),
        "line_sum": F.when(~invoice, 0.0).when(empty, total).otherwise(F.col("line_sum")),
    })


def _readings() -> dict[str, Column]:
    """Dates and amounts the rules compare, each read only for its own category."""
    def of(category: str, column: Column) -> Column:
        return F.when(F.col("category") == category, column)

    return {
        "r_invoice": of(INVOICE, parse_date(field_value("invoice_date"))),
        "r_due": of(INVOICE, parse_date(field_value("due_date"))),
        "r_subtotal": of(INVOICE, parse_num(field_value("subtotal", "0"))),
        "r_tax": of(INVOICE, parse_num(field_value("tax_amount", "0"))),
        "r_total": of(INVOICE, parse_num(field_value("grand_total", "0"))),
        "r_contract_end": of(CONTRACT, parse_date(field_value("expiration_date"))),
        "r_law": of(CONTRACT, F.lower(field_value("governing_law"))),
        "r_cap": of(CONTRACT, F.lower(field_value("liability_cap"))),
        "r_status": of(AUDIT, F.lower(field_value("status"))),
        "r_score": of(AUDIT, parse_num(field_value("compliance_score", "100"))),
        "r_deadline": of(AUDIT, parse_date(field_value("corrective_deadline"))),
        "r_id_end": of(IDENTITY, parse_date(field_value("expiry_date"))),
    }


def _conditions(as_of: Column) -> dict[str, Column]:
    c = F.col
    days_left = F.datediff(c("r_deadline"), as_of)
    return {
        "DATE_INCONSISTENCY": c("r_due") < c("r_invoice"),
        "INVOICE_OVERDUE": c("r_due") < as_of,
        "MATH_MISMATCH": (c("r_total") > 0) & (c("r_subtotal") > 0)
        & (F.abs(c("r_total") - c("r_expected")) > R.TOTAL_TOLERANCE),
        "LINE_ITEM_MISMATCH": (c("line_count") > 0) & (c("r_subtotal") > 0)
        & (F.abs(c("line_sum") - c("r_subtotal")) > R.LINE_SUM_TOLERANCE),
        "CONTRACT_EXPIRED": c("r_contract_end") < as_of,
        "HIGH_LEGAL_EXPOSURE": contains_any(c("r_law"), R.UNKNOWN_LAW),
        "UNCAPPED_LIABILITY": contains_any(c("r_cap"), R.OPEN_LIABILITY),
        "AUDIT_FAILURE": contains_any(c("r_status"), R.FAILED_AUDIT),
        "TIGHT_DEADLINE": days_left <= R.DEADLINE_DAYS,
        "ID_EXPIRED": c("r_id_end") < as_of,
        "ID_EXPIRING_SOON": (c("r_id_end") >= as_of)
        & (F.datediff(c("r_id_end"), as_of) < R.EXPIRY_DAYS),
    }


def _wording(as_of: Column) -> dict[str, Column]:
    c = F.col
    texts = {
        key: field_value(key)
        for key in ("due_date", "invoice_date", "expiration_date", "corrective_deadline",
                    "expiry_date")
    }
    return texts | {
        "days_overdue": F.datediff(as_of, c("r_due")),
        "total": money(c("r_total")),
        "subtotal": money(c("r_subtotal")),
        "tax": money(c("r_tax")),
        "expected": money(c("r_expected")),
        "delta": money(F.abs(c("r_total") - c("r_expected"))),
        "line_sum": money(c("line_sum")),
        "score": plain_number(c("r_score")),
    }


def _issue(rule: R.Issue, wording: dict[str, Column]) -> Column:
    return F.struct(
        F.lit(rule.severity).alias("severity"),
        fill(rule.field, **wording).alias("field"),
        fill(rule.title, **wording).alias("title"),
        fill(rule.message, **wording).alias("message"),
        F.lit(rule.code).alias("code"),
        F.lit(rule.penalty).alias("penalty"),
    )


def _field_issues() -> Column:
    """Per field, in field order: low confidence, then missing value."""
    low, missing = R.FIELD_ISSUES

    def of_field(f: Column) -> Column:
        confidence = F.coalesce(f["confidence"], F.lit(1.0))
        wording = {
            "key": f["key"],
            "label": F.coalesce(f["label"], f["key"]),
            "percent": percent(confidence),
        }
        is_missing = F.coalesce(strip(f["value"]), F.lit("")).isin(*R.MISSING_VALUES)
        return F.array(
            F.when(confidence < R.LOW_CONFIDENCE, _issue(low, wording)),
            F.when(is_missing, _issue(missing, wording)),
        )

    return F.flatten(F.transform("fields", of_field))


def rules_before(code: str) -> list[str]:
    """A rule of a category and those that come before it there: what its place among the issues depends on."""
    of = {rule.code: rule.category for rule in R.CATEGORY_ISSUES}
    mine = [rule for rule in of if of[rule] == of[code]]
    return mine[:mine.index(code) + 1]


def validate(docs: DataFrame, as_of: str = R.REFERENCE_AS_OF, rules: Collection[str] | None = None) -> DataFrame:
    """Add issues, issues_count, validation_score, validation_status and is_approved.

    Needs category, fields, line_count and line_sum; works per row. With `rules`, of the rules of categories only
    these are looked at; the line columns are needed for LINE_ITEM_MISMATCH alone.
    """
    today = F.lit(as_of).cast("date")
    before = docs.columns
    read = (
        docs.withColumn("field_values", field_values())
        .withColumns(_readings())
        .withColumn("r_expected", round_exact(F.col("r_subtotal") + F.col("r_tax")))
    )
    conditions, wording = _conditions(today), _wording(today)
    by_rule = F.array(*(
        F.when(conditions[rule.code], _issue(rule, wording))
        for rule in R.CATEGORY_ISSUES if rules is None or rule.code in rules
    ))
    flagged = evaluated(
        read,
        issues=F.array_compact(F.concat(_field_issues(), by_rule)).cast(f"array<{ISSUE_TYPE}>"),
    )
    has = {
        severity: F.exists("issues", lambda i: i["severity"] == severity)
        for severity in ("error", "warning")
    }
    status = F.when(has["error"], "error").when(has["warning"], "warning").otherwise("valid")
    lost = F.aggregate("issues", F.lit(0), lambda acc, i: acc + i["penalty"])
    kept = [name for name in before if name not in _OUTPUTS]
    return flagged.withColumn("status", status).select(
        *kept,
        "issues",
        F.size("issues").alias("issues_count"),
        F.greatest(F.lit(0), R.FULL_SCORE - lost).alias("validation_score"),
        F.col("status").alias("validation_status"),
        (F.col("status") == "valid").alias("is_approved"),
    )


_OUTPUTS = ("issues", "issues_count", "validation_score", "validation_status", "is_approved")


def issues_long(validated: DataFrame) -> DataFrame:
    return validated.select(
        "doc_id", F.posexplode("issues").alias("issue_ord", "i")
    ).select("doc_id", "issue_ord", "i.*")
