"""Text work is done once a query and few characters are tried by every pattern."""

import re

from pyspark.sql import functions as F

from ledgerleaf.functions import patterns
from ledgerleaf.operators import passages, portfolio
from ledgerleaf.operators.classify import candidates
from ledgerleaf.plans import pipeline
from ledgerleaf.registry.queries import QUERIES, audited, understood
from ledgerleaf.rules import categories as C, fields as X, passages as P
from ledgerleaf.sources import corpus as corpora


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_guards_turn_nothing_down(spark):
    rules = [r.pattern for some in (*X.FIELDS.values(), X.GENERIC_FIELDS) for r in some]
    assert all(patterns.first_characters(p) for p in rules)
    texts = ["ſtatus: PASSED", "İnvoice no: 42", "x\nDUE DATE: 2020-01-02", "paſſport no: AB12345", "Kid id number 1234567", "", "nothing", "id"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in rules:
        plain = "(?iu)" + patterns.spell(p)
        assert patterns.jvm(p) != plain
        assert rows.where(F.regexp_extract("text", patterns.jvm(p), 0) != F.regexp_extract("text", plain, 0)).count() == 0
    for rule in P.ENTITIES[1:3]:
        guarded = patterns.jvm_words(rule.pattern)
        plain = guarded[guarded.index("(?iu)"):]
        assert guarded.startswith("(?!") and rows.where(F.regexp_extract("text", guarded, 0) != F.regexp_extract("text", plain, 0)).count() == 0


def test_addresses_are_found_as_before_their_guard(spark):
    rule = P.ENTITIES[3]
    plain, guarded = patterns.jvm(rule.pattern, False), passages.entity_pattern(rule)
    assert rule.type == "EMAIL" and guarded != plain and guarded.endswith(plain)
    texts = ["a@b.co", "x.y+z%1@sub.example.com, -a@b.org a@@b.co", "éa@b.co é.a@b.co a@b.c a@.co", "%@b.co .@b.co _a_@b.co-x", "a b@c.de@f.gh", "@b.co", "no address", "İ@b.co a\n@b.co 9@8.ab|c"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in rows.select("text", F.regexp_extract_all("text", F.lit(plain), 0).alias("was"), F.regexp_extract_all("text", F.lit(guarded), 0).alias("now")).collect():
        assert row.was == row.now == [m.group() for m in re.finditer(rule.pattern, row.text)]


def test_lengths_of_gaps_are_counted_once(spark):
    text = "pay $5.00, then $7.50 and $5.00 until 2020-01-02; PO-12345 é a@b.co and a@b.co"
    found = passages.extract_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(e.value, text[slice(*e.span)]) for e in found.first().entities] == [(v, v) for v in ("$5.00", "$7.50", "2020-01-02", "PO-12345", "a@b.co")]
    plan = optimized(found)
    assert "aggregate(slice(lengths_0" in plan and "char_length" not in plan.split("aggregate(")[1].split("))")[0]


def test_optional_groups_have_no_guard():
    assert patterns.first_characters("(?:a|b)?c") is None and patterns.first_characters("a|b") is None
    assert patterns.first_characters("(?:a*|b)") is None and patterns.first_characters(r"(?:[\$x]|\d)") == set("$x0123456789")


def test_texts_are_read_once_in_cascade_delete(spark, sf):
    assert "regexp" not in optimized(QUERIES["cascade_delete"](spark, sf))


def test_texts_are_read_once_in_answers(spark, sf):
    assert "regexp_extract(text" not in optimized(QUERIES["answer_batch"](spark, sf))


def test_line_sums_meet_texts_before_the_text_work(spark):
    docs = spark.createDataFrame([(8, "a.pdf", "Invoice No: 42")], "doc_id long, original_name string, text string")
    tables = spark.createDataFrame([(8, 1, 0, [["h"], ["a", "1", "2.00", "2.00"]])], "doc_id long, page_number int, table_ord long, rows array<array<string>>")
    done = pipeline.process(docs, tables)
    plan = optimized(done)
    assert plan.index("Join LeftOuter") > plan.rindex("regexp_extract(text")
    assert done.select("category", "line_count", "line_sum").first()[1:] == (1, 2.0)


def test_recent_docs_reads_only_the_texts_it_shows(spark, sf):
    shown = QUERIES["recent_docs"](spark, sf)
    plan = optimized(shown)
    assert "regexp" in plan and "MASTER SERVICES" not in plan and plan.count("parquet") == 3
    whole = portfolio.recent_documents(audited(spark, sf)).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    assert shown.collect() == whole.collect()


def test_reports_capture_only_the_fields_they_show(spark, sf):
    asked, whole = understood(spark, sf, keys=portfolio.DEADLINE_KEYS), understood(spark, sf)
    assert optimized(asked).count("regexp_extract(text") == len(portfolio.DEADLINE_KEYS) < optimized(whole).count("regexp_extract(text")
    assert QUERIES["deadlines_by_date"](spark, sf).collect() == portfolio.deadlines(whole, by_date=True).collect()


def test_fields_of_some_keys_are_those_of_all(spark):
    docs = spark.createDataFrame([
        (1, "invoice.pdf", "Acme\nInvoice No: 42\nDue Date: 2020-01-02\nsubtotal"), (2, "contract.pdf", "agreement\nExpiration Date: 2021-02-03\nContractor: Bolt (x"),
        (3, "x.pdf", "title: a report"), (4, "kyc.pdf", "Passport No: AB12345\nExpiry Date: 2022-01-01")], "doc_id long, original_name string, text string")
    for keys in (portfolio.DEADLINE_KEYS, portfolio.COUNTERPARTY_KEYS, ()):
        some = {r.doc_id: [tuple(f) for f in r.fields] for r in pipeline.understand(docs, keys=keys).collect()}
        assert some == {r.doc_id: [tuple(f) for f in r.fields if f.key in keys] for r in pipeline.understand(docs).collect()}


def test_queries_of_a_category_score_its_words_first(spark):
    docs = spark.createDataFrame([
        (1, "a.pdf", "Invoice No: 42\nsubtotal"), (2, "b.pdf", "audit report by the inspector\nStatus: FAILED"), (3, "audit 7.txt", "nothing"), (4, "c.pdf", None),
        (5, "d.pdf", "invoice audit report"), (6, "e.pdf", "passport agreement whereas invoice"), (7, "nda bill.png", "osha"), (8, "kyc.pdf", "claim form copay"),
        (9, "contract_1.pdf", "vat"), (10, "f.pdf", "hazard hazard hazard invoice passed"), (11, "scan.pdf", ""), (12, "kyc 2.png", "report")], "doc_id long, original_name string, text string")
    whole = {r.doc_id: r for r in pipeline.understand(docs).collect()}
    assert {r.category for r in whole.values()} >= {C.INVOICE, C.CONTRACT, C.AUDIT, C.IDENTITY}
    for category in (C.INVOICE, C.CONTRACT, C.AUDIT, C.IDENTITY, C.CLAIM):
        some = pipeline.understand(docs, category=category)
        assert some.columns == pipeline.understand(docs).columns
        assert {r.doc_id: r for r in some.collect()} == {i: r for i, r in whole.items() if r.category == category}
    assert candidates(pipeline.prepare(docs), C.AUDIT).count() < docs.count() / 2


def test_issues_of_fields_need_no_order_lines(spark, sf):
    for name in ("rule_low_confidence", "rule_missing_field"):
        assert "line_sum" not in optimized(QUERIES[name](spark, sf))


def test_texts_are_written_in_many_tasks(spark, sf):
    """A table in one row group, or a join that ends in one partition, does not leave its texts to one task."""
    for name in ("invoices", "contracts", "audits", "identities", "claims", "free_texts"):
        rows = getattr(corpora, name)(spark, sf).groupBy(F.spark_partition_id().alias("task")).count().collect()
        total = sum(r["count"] for r in rows)
        assert len(rows) > 4 and max(r["count"] for r in rows) < total / 2
