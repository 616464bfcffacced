"""Business documents rendered from the relational tables.

Six kinds, one document per row of the driving table. Order lines are summed before they meet
their order, and reach the documents as one page table each, so that an order with any number of
lines is never gathered into one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerleaf.functions.text import fill
from ledgerleaf.sources.tables import table

KINDS = ("invoice", "contract", "audit", "identity", "claim", "text", "reject")

INVOICE_TEXT = """{vendor}
TAX INVOICE
Invoice No: INV-{number}
Invoice Date: {invoice_date}{due_line}
Vendor: {vendor}
Bill To: {customer}
Tax ID: US-EIN-{number}
Payment Terms: Net {days} Days
Summary of Charges
Line items: {line_count}
Subtotal: ${subtotal}
Tax (10%): ${tax}
Total Amount: ${total}
Parties Involved
Questions to billing{supplier}@example.com, reference PO-{number}"""

CONTRACT_TEXT = """MASTER SERVICES AGREEMENT
Agreement Title: Supply and Logistics Agreement {number}
This agreement is entered into by the parties hereto.
Effective Date: {effective}
Client: {vendor}
Contractor: Trading Company {number} (the Service Provider)
1. TERM
Expiration Date: {expiration}
Indemnification
Limitation of Liability: {cap}
Confidentiality Period: {years} years
2. DISPUTES
Governing Law: {law}
Whereas the client accepts the terms and conditions, section {years} applies.
In witness whereof the parties sign."""

AUDIT_TEXT = """COMPLIANCE AUDIT REPORT
Audit ID: AUD-{number}
Facility: {part} plant {brand}
Lead Inspector: Inspector of {type}
Audit Date: {audit_date}
Compliance Score: {score}.5%
Status: {status}
Remediation Deadline: {deadline}
Audit Findings
Findings and observations on every hazard
Safety inspection {status} under OSHA rules"""

IDENTITY_TEXT = """IDENTITY VERIFICATION
Full Name: {name} {segment}
Passport No: P{number}
Nationality: {nationality}
Date of Birth: {born}
Expiry Date: {expiry}
Issuing Authority: Office {office}"""

CLAIM_TEXT = """CLAIM FORM
Patient ID: {user}
Policy Number: {number}
Claim Amount: USD {amount}
Subject: {type} claim
Date: {day}
Contact: claims.{user}@example.org"""

# Spellings of a date, picked by key: Spark pattern and strftime pattern.
DATE_SHAPES = (
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("dd/MM/yyyy", "%d/%m/%Y"),
    ("M/d/yyyy", "%-m/%-d/%Y"),
    ("dd-MM-yyyy", "%d-%m-%Y"),
    ("MMMM d, yyyy", "%B %-d, %Y"),
    ("MMM d, yyyy", "%b %-d, %Y"),
    ("MMMM d yyyy", "%B %-d %Y"),
    ("MMM d yyyy", "%b %-d %Y"),
)
LAWS = ("State of Delaware", "England and Wales", "Singapore", "State of New York")
AUDIT_STATES = ("PASSED", "FAILED", "CONDITIONAL", "ACTION REQUIRED")
FIRST_NAMES = ("Ana", "Bruno", "Chen", "Dalia", "Emre")
NATIONS = ("Kenya", "Peru", "Japan", "Norway", "Canada", "Egypt")
FILE_NAMES = ("{kind}_{key}.txt", "scan-{key}.PDF", "{kind}.{key}.jpeg", "page {key}.png")
REJECT_NAMES = ("page {key}.docx", "{kind}_{key}", ".{key}")
TEXT_NAMES = ("{source}_{key}.txt", "contract_{key}.txt", "bill-{key}.pdf", "audit {key}.txt",
              "kyc_{key}.png", "nda.{key}.txt", "passport_{key}.jpg", "note_{key}.txt")


#: Tasks a core that the rows of a kind are dealt out to.
TASKS_PER_CORE = 4


def dealt(rows: DataFrame, key: str, deal: bool) -> DataFrame:
    """Rows dealt out by key before a text is written for each. A table may lie in a few large row groups and a join may end
    in a few partitions; what is done with the texts costs far more than the rows, and would be left to as few tasks."""
    return rows if rows.isStreaming or not deal else rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, key)


def pick(key: Column, values) -> Column:
    return F.element_at(
        F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)),
        (F.pmod(key, F.lit(len(values))) + 1).cast("int"),
    )


def padded(key: Column) -> Column:
    return F.lpad(key.cast("string"), 8, "0")


def spelled_date(day: Column, key: Column) -> Column:
    """One call with the pattern as a column: eight branches each time make methods too long for the JVM to compile."""
    return F.call_function("date_format", day, pick(key, [shape for shape, _ in DATE_SHAPES]))


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def plus_days(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


def amount(cents: Column) -> Column:
    return F.format_number(cents / F.lit(100.0), 2)


def _documents(rows: DataFrame, kind: str, key: Column, created: Column, text: Column) -> DataFrame:
    names = {"text": TEXT_NAMES, "reject": REJECT_NAMES}.get(kind, FILE_NAMES)
    source = F.col("source") if kind == "text" else F.lit("")
    name = pick(key, [
        fill(n, key=key, kind=F.lit(kind), source=source) for n in names
    ])
    return rows.select(
        (key * 8 + KINDS.index(kind)).alias("doc_id"),
        (F.pmod(key, F.lit(7)) + 1).alias("user_id"),
        name.alias("original_name"),
        F.when(F.pmod(key, F.lit(13)) != 0, "text/plain").alias("mime_type"),
        created.cast("timestamp_ntz").alias("created_at"),
        text.alias("text"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents, lines and first supplier per order, summed before the shuffle."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.count("*").alias("line_count"),
        F.min("l_suppkey").alias("s_suppkey"),
    )


def invoices(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """Orders as invoices: some totals are 900 off, some subtotals 25 off, some due dates absent
    or before the invoice date, some amounts without grouping, some pages blank."""
    key = F.col("o_orderkey")
    rows = (
        table(spark, sf_dir, "orders")
        .join(order_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    )
    rows = (
        dealt(rows, "o_orderkey", deal)
        .withColumn("sub", F.col("cents") + F.when(F.pmod(key, F.lit(13)) == 0, 2500).otherwise(0))
        .withColumn("tax", F.floor((F.col("sub") + 5) / 10).cast("long"))
        .withColumn(
            "total",
            F.col("sub") + F.col("tax") + F.when(F.pmod(key, F.lit(7)) == 0, 90000).otherwise(0),
        )
    )
    day = F.col("o_orderdate").cast("date")
    due = F.date_add(
        day,
        F.when(F.pmod(key, F.lit(17)) == 0, -5)
        .otherwise(15 + F.pmod(key, F.lit(46))).cast("int"),
    )
    due_line = F.when(F.pmod(key, F.lit(11)) == 0, "").otherwise(
        F.concat(F.lit("\nDue Date: "), spelled_date(due, F.floor(key / 8))))
    total = F.when(F.pmod(key, F.lit(19)) == 0, F.replace(
        amount(F.col("total")), F.lit(","), F.lit(""))).otherwise(amount(F.col("total")))
    text = fill(
        INVOICE_TEXT,
        vendor=F.replace(F.col("s_name"), F.lit("#"), F.lit(" ")),
        customer=F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")),
        number=padded(key),
        invoice_date=spelled_date(day, key),
        due_line=due_line,
        days=F.pmod(key, F.lit(46)) + 15,
        line_count=F.col("line_count"),
        subtotal=amount(F.col("sub")),
        tax=amount(F.col("tax")),
        total=total,
        supplier=F.col("s_suppkey"),
    )
    text = F.when(F.pmod(key, F.lit(97)) == 5, " \n").otherwise(text)
    return _documents(rows, "invoice", key, F.col("o_orderdate"), text)


def invoice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a page table with a header row (doc_id, page_number, table_ord, rows).

    Line number 7 carries an empty cell to drop; every 50th part has too few cells."""
    c = F.col
    short = F.pmod(c("l_partkey"), F.lit(50)) == 0
    cells = F.array(
        F.concat(F.lit("Part "), c("l_partkey")),
        F.when(c("l_linenumber") == 7, None).otherwise(F.lit(" ")),
        c("l_quantity").cast("long").cast("string"),
        F.format_number(c("l_extendedprice") / c("l_quantity"), 2),
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)),
    )
    kept = F.filter(cells, lambda cell, i: (i != 1) | cell.isNull())
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return lines.select(
        (c("l_orderkey") * 8).alias("doc_id"),
        c("l_linenumber").cast("int").alias("page_number"),
        c("l_suppkey").alias("table_ord"),
        F.array(
            F.array(*(F.lit(h) for h in ("Description", "Qty", "Unit Price", "Total"))),
            F.when(short, F.slice(kept, 1, 2)).otherwise(kept),
        ).alias("rows"),
    )


def contracts(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    key = F.col("s_suppkey")
    rows = dealt(table(spark, sf_dir, "supplier"), "s_suppkey", deal)
    effective = plus_days("1995-06-01", F.pmod(key * 37, F.lit(900)))
    text = fill(
        CONTRACT_TEXT,
        number=key,
        vendor=F.replace(F.col("s_name"), F.lit("#"), F.lit(" ")),
        effective=spelled_date(effective, key),
        expiration=spelled_date(F.date_add(effective, F.lit(1000)), key + 3),
        cap=F.when(F.pmod(key, F.lit(3)) == 0, "Uncapped / Unlimited Indemnification")
        .otherwise(F.concat(F.lit("$"), (F.pmod(key, F.lit(9)) + 1).cast("string"), F.lit(",000,000"))),
        years=F.pmod(key, F.lit(5)) + 1,
        law=F.when(F.pmod(key, F.lit(4)) == 0, "Not Specified (High Risk)")
        .otherwise(pick(F.col("s_nationkey"), LAWS)),
    )
    return _documents(rows, "contract", key, effective, text)


def audits(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    key = F.col("p_partkey")
    day = plus_days("1998-06-01", F.pmod(key * 11, F.lit(200)))
    text = fill(
        AUDIT_TEXT,
        number=padded(key),
        part=F.col("p_name"),
        brand=F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")),
        type=F.col("p_type"),
        audit_date=spelled_date(day, key),
        score=F.col("p_size") + 45,
        status=pick(key, AUDIT_STATES),
        deadline=iso(F.date_add(day, F.lit(30))),
    )
    return _documents(dealt(table(spark, sf_dir, "part"), "p_partkey", deal), "audit", key, day, text)


def identities(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    key = F.col("c_custkey")
    expiry = plus_days("1997-01-01", F.pmod(key * 13, F.lit(1500)))
    text = fill(
        IDENTITY_TEXT,
        name=pick(key, FIRST_NAMES),
        segment=F.lower(F.col("c_mktsegment")),
        number=padded(key),
        nationality=pick(F.col("c_nationkey"), NATIONS),
        born=iso(plus_days("1950-01-01", F.pmod(key * 29, F.lit(14000)))),
        expiry=iso(expiry),
        office=F.pmod(key, F.lit(40)),
    )
    return _documents(
        dealt(table(spark, sf_dir, "customer"), "c_custkey", deal), "identity", key,
        plus_days("1997-01-01", F.pmod(key * 7, F.lit(700))), text,
    )


def claims(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    key = F.col("event_id")
    text = fill(
        CLAIM_TEXT,
        user=F.col("user_id"),
        number=key,
        amount=F.format_number("value", 2),
        type=F.col("event_type"),
        day=iso(F.col("ts")),
    )
    return _documents(dealt(table(spark, sf_dir, "events"), "event_id", deal), "claim", key, F.col("ts"), text)


def name_texts(rows: DataFrame) -> DataFrame:
    """Free texts (doc_id, source, text), at rest or arriving, as documents."""
    key = F.col("doc_id")
    return _documents(
        rows, "text", key,
        plus_days("1998-01-01", F.pmod(key, F.lit(900))), F.col("text"),
    )


def free_texts(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    return name_texts(dealt(table(spark, sf_dir, "documents"), "doc_id", deal))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few files of an extension that is not accepted."""
    key = F.col("n_nationkey").cast("long")
    return _documents(
        table(spark, sf_dir, "nation"), "reject", key,
        plus_days("1998-01-01", key), F.col("n_name"),
    )


def corpus(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """All six kinds of document, the rows of each dealt out evenly unless the texts are of no interest."""
    kinds = (invoices, contracts, audits, identities, claims, free_texts)
    return reduce(DataFrame.unionByName, (kind(spark, sf_dir, deal) for kind in kinds))
