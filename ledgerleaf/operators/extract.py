"""Field and line-item extraction."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.stages import evaluated
from ledgerleaf.functions.text import capture, first_line, lines, matches, strip, strip_cheaply
from ledgerleaf.rules import fields as R
from ledgerleaf.rules.categories import INVOICE

FIELD_TYPE = (
    "array<struct<key:string,value:string,confidence:double,page:int,label:string,"
    "is_default:boolean>>"
)
ITEM_TYPE = "struct<description:string,quantity:string,unit_price:string,total:string>"


def by_category(branches: dict[str, Column], otherwise: Column) -> Column:
    """A CASE on the category, so only the matching branch is evaluated."""
    chain = F
    for category, column in branches.items():
        chain = chain.when(F.col("category") == category, column)
    return chain.otherwise(otherwise)


def _captures(rules) -> Column:
    if not rules:
        return F.array().cast("array<string>")
    return F.array(*(capture(F.col("text"), rule.pattern) for rule in rules))


def _heading_vendor() -> Column:
    """The first of the top page-1 lines that does not look like a document heading."""
    top = F.slice(
        F.filter(lines(F.col("first_page")), lambda line: strip_cheaply(line) != ""),
        1, R.VENDOR_HEADING_LINES,
    )
    fits = F.filter(
        top,
        lambda line: ~matches(line, R.NOT_A_VENDOR) & (F.length(line) > R.VENDOR_MIN_LENGTH),
    )
    return strip(F.get(fits, F.lit(0)))


def _rule_rows(rules, defaults: str) -> Column:
    return F.array(*(
        F.struct(
            F.lit(rule.key).alias("key"),
            F.lit(rule.default).alias("default"),
            F.lit(rule.default if defaults == "reference" else None).cast("string").alias("shown"),
            F.lit(rule.confidence).alias("confidence"),
            F.lit(rule.page).alias("page"),
            F.lit(rule.label).alias("label"),
        )
        for rule in rules
    ))


def _fields(rules, defaults: str) -> Column:
    """One field per rule and capture."""
    if not rules:
        return F.array().cast(FIELD_TYPE)
    rows = _rule_rows(rules, defaults)
    heading = F.col("heading_vendor")

    def field(raw: Column, position: Column) -> Column:
        rule = F.get(rows, position)
        missed, read = raw == "", first_line(raw)
        value = F.when(missed, rule["shown"]).otherwise(read)
        if any(r.key == "vendor_name" for r in rules):
            vendor = (rule["key"] == "vendor_name") & heading.isNotNull()
            value = F.when(
                vendor & (missed | (read == rule["default"])), heading
            ).otherwise(value)
            missed = missed & ~vendor
        return F.struct(
            rule["key"].alias("key"),
            value.alias("value"),
            rule["confidence"].alias("confidence"),
            rule["page"].alias("page"),
            rule["label"].alias("label"),
            missed.alias("is_default"),
        )

    return F.transform(F.col("captures"), field)


def extract_fields(classified: DataFrame, defaults: str = "reference", keys: Collection[str] | None = None) -> DataFrame:
    """Add ``fields`` in rule order; with `keys`, these fields alone, for reports that show no others.

    defaults='reference' reports the rule's default for a field that is not found;
    defaults='null' reports null, so that validation can flag it as missing.
    """
    def asked(rules):
        return [rule for rule in rules if keys is None or rule.key in keys]

    of = {c: asked(rules) for c, rules in R.FIELDS.items()}
    vendor = any(rule.key == "vendor_name" for rule in of[INVOICE])
    captured = classified.withColumns({
        "captures": by_category({c: _captures(rules) for c, rules in of.items()}, _captures(asked(R.GENERIC_FIELDS))),
        "heading_vendor": F.when(F.col("category") == INVOICE, _heading_vendor()) if vendor else F.lit(None).cast("string"),
    })
    fields = by_category({c: _fields(rules, defaults) for c, rules in of.items()}, _fields(asked(R.GENERIC_FIELDS), defaults))
    return evaluated(captured, fields=fields.cast(FIELD_TYPE)).drop("captures", "heading_vendor")


def fields_long(extracted: DataFrame) -> DataFrame:
    """One row per document and field, with its position."""
    return extracted.select("doc_id", "category", F.posexplode("fields").alias("field_ord", "f")).select(
        "doc_id", "category", "field_ord", "f.*"
    )


def extraction_coverage(extracted: DataFrame) -> DataFrame:
    """Share of documents in which a field was not found, per category and field."""
    return (
        fields_long(extracted)
        .groupBy("category", "key")
        .agg(
            F.count("*").alias("documents"),
            F.count_if("is_default").alias("defaulted"),
        )
        .withColumn("default_share", F.col("defaulted") / F.col("documents"))
    )


def default_line_items() -> Column:
    return F.array(*(
        F.struct(*(F.lit(cell).alias(name) for cell, name in zip(
            item, ("description", "quantity", "unit_price", "total"))))
        for item in R.DEFAULT_LINE_ITEMS
    )).cast(f"array<{ITEM_TYPE}>")


def table_items(table: Column) -> Column:
    """Line items of one table: header row off, null cells out, at least three cells left."""
    rows = F.transform(
        F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0))),
        lambda row: F.transform(F.filter(row, lambda c: c.isNotNull()), strip),
    )
    return F.transform(
        F.filter(rows, lambda cells: F.size(cells) >= R.MIN_ITEM_CELLS),
        lambda cells: F.struct(
            cells[0].alias("description"),
            cells[1].alias("quantity"),
            cells[2].alias("unit_price"),
            F.element_at(cells, -1).alias("total"),
        ),
    )


def page_line_items(pages: Column) -> Column:
    """Line items of all tables of all pages of one document, in order."""
    return F.flatten(F.transform(
        pages,
        lambda page: F.flatten(F.transform(
            F.coalesce(page["tables"], F.array().cast("array<array<array<string>>>")), table_items
        )),
    ))


def line_items_from_tables(page_tables: DataFrame) -> DataFrame:
    """Line items from a long table of page tables (doc_id, page_number, table_ord, rows).

    Row-local: no document is ever gathered, however many tables it has."""
    return page_tables.select(
        "doc_id", "page_number", "table_ord",
        F.posexplode(table_items(F.col("rows"))).alias("item_ord", "item"),
    ).select("doc_id", "page_number", "table_ord", "item_ord", "item.*")


def with_nested_items(docs: DataFrame, page_tables: DataFrame, defaults: str = "reference") -> DataFrame:
    """Add ``line_items`` from a long table of page tables, by page, table and row, for outputs that
    hold a document whole. Invoices without any get the default ones ('reference') or none."""
    at = F.struct("page_number", "table_ord", "item_ord", F.struct("description", "quantity", "unit_price", "total").alias("item"))
    gathered = line_items_from_tables(page_tables).groupBy("doc_id").agg(F.sort_array(F.collect_list(at)).alias("_items"))
    none = F.array().cast(f"array<{ITEM_TYPE}>")
    items = F.when(F.col("category") != INVOICE, none).when(
        F.size("_items") > 0, F.transform("_items", lambda i: i["item"]).cast(f"array<{ITEM_TYPE}>")
    ).otherwise(default_line_items() if defaults == "reference" else none)
    return docs.join(gathered, "doc_id", "left").withColumn("line_items", items).drop("_items")


def with_default_items(items: DataFrame, classified: DataFrame) -> DataFrame:
    """Line items of the invoices, the default ones where an invoice has none."""
    invoices = classified.where(F.col("category") == INVOICE).select("doc_id")
    # distinct() drops the copies of a much-itemised document before the shuffle.
    without = invoices.join(items.select("doc_id").distinct(), "doc_id", "left_anti")
    filled = without.select(
        "doc_id",
        F.lit(1).alias("page_number"),
        F.lit(0).alias("table_ord"),
        F.posexplode(default_line_items()).alias("item_ord", "item"),
    ).select("doc_id", "page_number", "table_ord", "item_ord", "item.*")
    return items.join(invoices, "doc_id", "left_semi").unionByName(filled)
