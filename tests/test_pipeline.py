"""Golden documents, rule boundaries, and batch against stream."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import assistant, changes, classify, passages, validate
from ledgerleaf.operators.insights import add_insights
from ledgerleaf.plans import pipeline, warehouse
from ledgerleaf.rules import categories as C
from ledgerleaf.rules import fields as X
from ledgerleaf.rules import passages as P
from ledgerleaf.sources import files, pages
from ledgerleaf.streaming.ingest import ingest_stream

SMALL_INVOICE = (
    "INVOICE #INV-9999\nVendor: Alpha Cloud\nDate: 2026-09-20\nTotal Amount: .00\n"
    "Subtotal: .00\nTax: .00"
)


def given(spark, category, line_sum=12450.0, line_count=3, **values):
    """A document with the category's default fields, some of them replaced."""
    rules = X.FIELDS.get(category, X.GENERIC_FIELDS)
    fields = [(r.key, values.get(r.key, r.default), r.confidence, r.page, r.label, False) for r in rules]
    return spark.createDataFrame(
        [(1, category, fields, line_count, line_sum)],
        "doc_id bigint, category string, fields array<struct<key:string,value:string,"
        "confidence:double,page:int,label:string,is_default:boolean>>, line_count bigint, "
        "line_sum double",
    )


def outcome(docs, as_of="2026-09-25"):
    row = add_insights(validate.validate(docs, as_of)).first()
    return (
        [i.code for i in row.issues], row.validation_score, row.validation_status,
        [i.badge for i in row.insights],
    )


def test_valid_invoice(spark):
    assert outcome(given(spark, C.INVOICE, due_date="2026-10-15")) == (
        [], 100, "valid", ["Early Payment Discount", "Vendor Intelligence", "Budget Allocation"])


def test_risky_contract(spark):
    assert outcome(given(spark, C.CONTRACT)) == (
        ["CONTRACT_EXPIRED", "HIGH_LEGAL_EXPOSURE", "UNCAPPED_LIABILITY"], 15, "error",
        ["Legal Exposure Alert", "Mandatory Remediation", "Lifecycle Governance"])


F3 = dict(invoice_date="2026-08-01", due_date="2026-08-20", subtotal="8,500.00",
          tax_amount="850.00", line_sum=8500.0, line_count=2)


def test_mismatched_invoice(spark):
    docs = given(spark, C.INVOICE, grand_total="10,250.00", **F3)
    assert outcome(docs) == (
        ["INVOICE_OVERDUE", "MATH_MISMATCH"], 50, "error",
        ["Discrepancy Audit", "Vendor Intelligence", "Budget Allocation"])
    issues = validate.validate(docs).first().issues
    assert issues[0].title == "Invoice Payment Overdue (36 Days)"
    assert issues[1].message.endswith("($8,500.00 + $850.00 = $9,350.00). Delta: $900.00.")


def test_edited_total(spark):
    docs = given(spark, C.INVOICE, grand_total="10,250.00", **F3)
    edits = spark.createDataFrame(
        [(1, "grand_total", " 9,350.00 ", 2), (1, "no_such_field", "x", 1), (1, "grand_total", "9,999.00", 1)],
        "doc_id bigint, key string, value string, edit_no int")
    row = changes.recompute(docs, edits).first()
    assert ([i.code for i in row.issues], row.validation_score) == (["INVOICE_OVERDUE"], 85)
    assert [f.value for f in row.fields if f.key == "grand_total"] == ["9,350.00"]


def test_failed_audit(spark):
    assert outcome(given(spark, C.AUDIT)) == (
        ["AUDIT_FAILURE", "TIGHT_DEADLINE"], 45, "error",
        ["Regulatory Action Required", "Audit Protocol"])


def test_expiring_passport(spark):
    assert outcome(given(spark, C.IDENTITY)) == (
        ["ID_EXPIRING_SOON"], 85, "warning", ["KYC Verification", "Expiration Warning"])


@pytest.mark.parametrize("category, values, codes", [
    (C.INVOICE, dict(due_date="2026-09-25", grand_total="13,695.05"), []),
    (C.INVOICE, dict(due_date="2026-09-25", grand_total="13,695.06"), ["MATH_MISMATCH"]),
    (C.INVOICE, dict(due_date="2026-09-25", subtotal="0"), []),
    (C.AUDIT, dict(status="PASSED", corrective_deadline="2026-10-06"), []),
    (C.AUDIT, dict(status="PASSED", corrective_deadline="2026-09-24"), ["TIGHT_DEADLINE"]),
    (C.IDENTITY, dict(expiry_date="2026-10-24"), ["ID_EXPIRING_SOON"]),
    (C.IDENTITY, dict(expiry_date="2026-10-25"), []),
    (C.IDENTITY, dict(expiry_date="2026-09-25"), ["ID_EXPIRING_SOON"]),
    (C.IDENTITY, dict(expiry_date="2026-09-24"), ["ID_EXPIRED"]),
])
def test_rule_boundaries(spark, category, values, codes):
    assert outcome(given(spark, category, **values))[0] == codes


def test_score_floor(spark):
    gone = {r.key: "N/A" for r in X.FIELDS[C.AUDIT]}
    codes, score, status, _ = outcome(given(spark, C.AUDIT, **gone))
    assert codes.count("MISSING_FIELD") == 7 and score == 0 and status == "error"


def documents(spark, *rows):
    return spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(rows)],
        "doc_id bigint, original_name string, text string")


def test_small_text_invoice(spark):
    row = pipeline.process(documents(spark, ("test_invoice.txt", SMALL_INVOICE))).first()
    assert (row.category, row.category_confidence, row.best_score) == (C.INVOICE, 0.92, 100.8)
    values = {f.key: f.value for f in row.fields if not f.is_default}
    assert values == {"invoice_number": "INV-9999", "invoice_date": "2026-09-20",
                      "vendor_name": "Alpha Cloud"}
    assert (row.validation_score, row.validation_status, row.issues) == (100, "valid", [])
    assert [(s.title, s.content.count("\n")) for s in row.sections] == [("Document Overview", 5)]
    assert [(e.type, e.value) for e in row.entities] == [
        ("DATE", "2026-09-20"), ("IDENTIFIER", "INVOICE"), ("IDENTIFIER", "INV-9999")]
    strict = pipeline.process(
        documents(spark, ("test_invoice.txt", SMALL_INVOICE)), defaults="null").first()
    assert [i.code for i in strict.issues] == ["MISSING_FIELD"] * 7
    assert (strict.validation_score, strict.validation_status) == (0, "error")


@pytest.mark.parametrize("name, text, expected", [
    ("a.txt", "the subtotal", (C.REPORT, 0.72)),
    ("a.txt", "balance due", (C.INVOICE, 0.82)),
    ("video.txt", "nothing here", (C.IDENTITY, 0.85)),
    ("my_bill.txt", "nothing here", (C.INVOICE, 0.85)),
    ("a.txt", "an invoice", (C.INVOICE, 0.85)),
    ("a.txt", "hazard hazard hazard hazard", (C.AUDIT, 0.86)),
])
def test_classifier(spark, name, text, expected):
    row = classify.classify(documents(spark, (name, text))).first()
    assert (row.category, row.category_confidence) == expected


def test_sections(spark):
    text = "intro\n\nNotes:\nSUMMARY OF CHARGES\n" + "\n".join(f"l{i}" for i in range(9))
    row = passages.extract_sections(documents(spark, ("a", "1) start\n" + text))).first()
    assert [(s.title, len(s.content.split("\n"))) for s in row.sections] == [
        ("Document Overview", 1), ("SUMMARY OF CHARGES", 8)]
    many = "\n".join(f"SECTION ABCD\nx{i}" for i in range(11))
    assert len(passages.extract_sections(documents(spark, ("a", many))).first().sections) == 10


def spans_by_re(text):
    seen, out = set(), []
    for rule in P.ENTITIES:
        flags = re.IGNORECASE if rule.ignore_case else 0
        for m in re.finditer(rule.pattern, text, flags):
            if (rule.type, m.group()) not in seen:
                seen.add((rule.type, m.group()))
                out.append((rule.type, m.group(), list(m.span())))
    return out[:P.MAX_ENTITIES]


def test_entities_match_python(spark, sf):
    tricky = [
        "é€ 1,234.50 and $5 usd 12 GBP1,000.00 EUR 7",
        "caféID1234 ID 12345 id_9999 ref#ABCD1 REF  ABCDE éINV-2024",
        "2024-01-05 x2024-01-05 1/2/24 Jan 5, 2024 september 12 2020é ٢024-1-1",
        "a@b.co .x@y.org me@site.c|m, +a@b.info_ " + chr(0xFDD0) + " $9 " + chr(0xFDD1),
        " ".join(f"ID {i:05}" for i in range(40)) + " ID 00000",
        "",
    ]
    rows = documents(spark, *(("t", t) for t in tricky)).union(
        spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100", "source", "text"))
    got = passages.extract_entities(rows).select("text", "entities").collect()
    for row in got:
        plain = row.text.replace(chr(0xFDD0), chr(0xFDD1))
        assert [(e.type, e.value, list(e.span)) for e in row.entities] == spans_by_re(plain)


def test_capped_and_distinct(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id", "source AS original_name", "text")
    for row in pipeline.process(docs).collect():
        pairs = [(e.type, e.value) for e in row.entities]
        assert len(pairs) == len(set(pairs)) <= 25 and len(row.sections) <= 10
        assert 0 <= row.validation_score <= 100


def test_nested_tables(spark):
    table = [["Item", "Qty", "Rate", "Total"], ["Valves", None, "10", "$500.00", "$5,000.00"],
             [" Seals ", "7", "$3,500.00"], ["note", "only"]]
    page = [(1, "INVOICE\nSubtotal: $8,500.00", [table, [["header only"]]])]
    docs = spark.createDataFrame(
        [(1, "bill.pdf", "INVOICE\nSubtotal: $8,500.00 balance due", page)],
        "doc_id bigint, original_name string, text string, pages array<struct<page_number:int,"
        "text:string,tables:array<array<array<string>>>>>")
    row = pipeline.process(docs).first()
    assert [tuple(i) for i in row.line_items] == [
        ("Valves", "10", "$500.00", "$5,000.00"), ("Seals", "7", "$3,500.00", "$3,500.00")]
    assert (row.line_count, row.line_sum) == (2, 8500.0)


def test_text_files_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "bad bytes.txt").write_bytes(b"caf\xff\xe9 one\r\ntwo\rthree \xef\xbf")
    (folder / "test_invoice.txt").write_text(SMALL_INVOICE)
    (folder / "empty.txt").write_text(" \n")
    (folder / "notes.docx").write_text("rejected")
    read = files.read_text_files(spark, str(folder))
    texts = {r.original_name: r.text for r in read.collect()}
    assert texts["bad bytes.txt"] == "caf one\ntwo\nthree "
    columns = ["original_name", "category", "text", "fields", "issues", "validation_score"]
    batch = pipeline.process(pipeline.accepted(read)).select(*columns)
    out = str(tmp_path / "out")
    ingest_stream(
        files.stream_text_files(spark, str(folder)), out, str(tmp_path / "state")
    ).awaitTermination()
    stream = spark.read.parquet(out).select(*columns)
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.collect()))
    assert {r.text for r in stream.collect() if r.original_name == "empty.txt"} == {
        "Scanned/Image document: empty.txt\nVisual OCR processed."}


def test_long_document_is_one_row(spark):
    rows = [(1, n, f" page {n} \n") for n in range(1, 8)] + [(2, 1, "only")]
    df = spark.createDataFrame(rows, "doc_id bigint, page_number int, text string")
    whole = {r.doc_id: r.text for r in pages.assemble(df).collect()}
    assert whole[1] == "".join(f"\n--- Page {n} ---\n{t}" for _, n, t in rows[:7]).strip()
    cut = {r.doc_id: (r.page_count, r.text) for r in pages.assemble(df, pages_per_part=3).collect()}
    assert cut == {1: (7, whole[1]), 2: (1, whole[2])}
    late = pages.assemble(df.where("page_number > 5"), pages_per_part=3).first()
    assert late.text.startswith("--- Page 6 ---") and late.page_count == 2
    back = pages.split_pages(pages.assemble(df)).orderBy("doc_id", "page_number").collect()
    assert [r.text.strip() for r in back] == [t.strip() for _, _, t in rows]


def test_hot_documents_are_salted(spark, monkeypatch):
    from ledgerleaf.functions import skew

    monkeypatch.setattr(skew, "HOT_SHARE", 5)
    many = spark.range(3000).selectExpr("id AS question_id", "if(id % 3 = 0, 0, id % 50) AS doc_id")
    one = spark.range(40).selectExpr("id AS doc_id", "concat('d', id) AS name")
    joined = skew.join_many_to_one(many, one, "doc_id")
    plain = many.join(one, "doc_id")
    assert sorted(map(tuple, joined.select("question_id", "doc_id", "name").collect())) == sorted(
        map(tuple, plain.select("question_id", "doc_id", "name").collect()))


def test_answers(spark):
    processed = pipeline.process(documents(
        spark, ("test_invoice.txt", SMALL_INVOICE), ("plain.txt", "Some words\nabout harvest yields")))
    asked = spark.createDataFrame([
        (1, 0, "What is the total amount?"), (2, 0, "When is it due?"), (3, 0, "Any risk?"),
        (4, 0, "Summarize"), (5, 0, "who sent it"), (6, 1, "harvest?"), (7, 1, "hm"),
        (8, 1, "the total cost?"), (9, 0, "validate it"),
    ], "question_id int, doc_id bigint, question string")
    got = {r.question_id: r for r in assistant.answer_batch(asked, processed).collect()}
    intents = [got[i].intent for i in sorted(got)]
    assert intents == ["money_invoice", "dates", "risk", "summary", "parties", "search",
                       "overview", "overview", "dates"]
    assert got[1].answer.endswith("* **Payment Terms**: Net 30 Days")
    assert got[2].answer.startswith(
        "### Key Dates & Deadlines Identified\n* **Invoice Date**: `2026-09-20` (Confidence: 96%)")
    assert got[3].citations[0].field == "Health Score"
    assert '> *"about harvest yields"*' in got[6].answer
    assert "**plain.txt**" in got[7].answer
    rows = changes.chat_rows(assistant.answer_batch(asked, processed)).collect()
    assert len(rows) == 18 and {r.role for r in rows} == {"user", "assistant"}


def test_filters_stay_above_the_text_work(spark):
    """A filter on a computed column must not copy the classifier below itself."""
    audited = pipeline.audit(documents(spark, ("a.txt", SMALL_INVOICE)))
    for condition in ("validation_status = 'valid'", "category = 'Commercial Invoice'",
                      "size(issues) = 0", "size(fields) > 3"):
        kept = audited.where(condition)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("severability") == 1
        assert kept.count() == 1


def test_store_and_reload(spark, tmp_path):
    docs = documents(spark, ("test_invoice.txt", SMALL_INVOICE), ("b.txt", "x")).withColumn(
        "mime_type", F.lit(None).cast("string"))
    path = str(tmp_path / "stored")
    warehouse.store(pipeline.process(docs), path)
    stored = warehouse.load(spark, path)
    assert {r.mime_type for r in stored.collect()} == {"application/pdf"}
    assert warehouse.new_only(docs, stored).count() == 0
    assert warehouse.long_tables(stored)["fields"].count() == 12
    assert warehouse.long_tables(stored)["line_items"].count() == len(X.DEFAULT_LINE_ITEMS)


def test_export_json(spark):
    import json

    from ledgerleaf.operators import exports

    docs = documents(spark, ("test_invoice.txt", SMALL_INVOICE)).withColumns({
        "created_at": F.lit("2026-09-20 10:00:00").cast("timestamp_ntz")})
    processed = pipeline.process(docs)
    out = json.loads(exports.export_json(processed).first().json)
    assert list(out) == ["export_metadata", "extracted_fields", "line_items",
                         "validation_issues", "knowledge_insights"]
    assert out["export_metadata"]["processed_at"] == "2026-09-20 10:00:00"
    assert out["extracted_fields"]["vendor_name"] == "Alpha Cloud"
    assert [i["total"] for i in out["line_items"]] == [i[-1] for i in X.DEFAULT_LINE_ITEMS]
    assert len(out["knowledge_insights"]) == 3 and out["validation_issues"] == []


def test_export_json_with_page_tables(spark):
    import json

    from ledgerleaf.operators import exports, extract

    docs = documents(spark, ("a.txt", SMALL_INVOICE), ("b.txt", SMALL_INVOICE), ("c.txt", "nothing")).withColumns({
        "created_at": F.lit("2026-09-20 10:00:00").cast("timestamp_ntz")})
    rows = [(i, p, t, [["Description", "Qty", "Price", "Total"], [f"item {p}.{t}", "1", None, "2.00", "2.00"]])
            for i in (0, 2) for p in range(1, 31) for t in (2, 1)]
    tables = spark.createDataFrame(rows, "doc_id bigint, page_number int, table_ord bigint, rows array<array<string>>")
    items = {}
    for defaults in ("reference", "null"):
        processed = pipeline.process(docs, tables, defaults)
        full = extract.with_nested_items(processed, tables, defaults)
        items[defaults] = {r.doc_id: json.loads(r.json)["line_items"] for r in exports.export_json(full).collect()}
    got = items["reference"]
    assert [i["description"] for i in got[0]] == [f"item {p}.{t}" for p in range(1, 31) for t in (1, 2)]
    assert got[0][0] == {"description": "item 1.1", "quantity": "1", "unit_price": "2.00", "total": "2.00"}
    assert [i["total"] for i in got[1]] == [i[-1] for i in X.DEFAULT_LINE_ITEMS] and got[2] == []
    assert items["null"] == {**got, 1: []}


def test_export_json_query_holds_every_item(spark, sf):
    import json

    from ledgerleaf.registry.queries import QUERIES

    assert sum(len(json.loads(r.json)["line_items"]) for r in QUERIES["export_json"](spark, sf).collect()) == QUERIES["line_items"](spark, sf).count()


def test_no_caps(spark):
    text = "\n".join(f"{h * 5}\n" + "\n".join(f"line {i} of {h}: the vendor pays ${i}{i}.00 to {h}{i}@example.com" for i in range(12)) for h in "ABCDEFGHIJKLMN")
    docs = documents(spark, ("a.txt", text))
    counts = {}
    for caps in ("reference", None):
        done = pipeline.process(docs, caps=caps)
        long = warehouse.long_tables(done)
        counts[caps] = (long["entities"].count(), long["sections"].count(), max(r.content.count("\n") + 1 for r in long["sections"].collect()),
                        assistant.snippet_search(docs, "Which vendor?", caps).count())
    assert counts["reference"] == (P.MAX_ENTITIES, P.MAX_SECTIONS, P.MAX_SECTION_LINES, 4)
    assert counts[None] == (12 + 14 * 12, 14, 12, 14 * 12)
    every = passages.extract_entities(docs, caps=None).first()
    assert all(text[a:b] == e.value for e in every.entities for a, b in [e.span])


@pytest.mark.parametrize("turned", [False, True])
def test_changes_do_not_depend_on_row_order(spark, turned):
    def frame(rows, schema):
        return spark.createDataFrame(rows[::-1] if turned else rows, schema)

    current = frame([(1, "old"), (2, "kept")], "doc_id bigint, state string")
    incoming = frame([(1, "first", 1), (1, "second", 2), (3, "new", 1)], "doc_id bigint, state string, version int")
    got = changes.upsert(current, incoming).collect()
    assert sorted(map(tuple, got)) == [(1, "second"), (2, "kept"), (3, "new")]
    fields = frame([(1, "a", "x"), (1, "b", "y")], "doc_id bigint, key string, value string")
    edits = frame([(1, "a", " zz", 1), (1, "a", "aa ", 2), (1, "c", "-", 3)],
                  "doc_id bigint, key string, value string, edit_no int")
    got = changes.apply_edits(fields, edits).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "aa"), (1, "b", "y")]


def test_long_amounts_are_summed(spark):
    items = spark.createDataFrame(
        [(1, "$" + "9" * 25), (1, "1.50"), (2, "2.25"), (2, ""), (3, "9" * 400)], "doc_id bigint, total string")
    got = {r.doc_id: (r.line_count, r.line_sum) for r in validate.line_totals(items).collect()}
    assert got[1][0] == 2 and got[1][1] == pytest.approx(1e25)
    assert got[2] == (2, 2.25) and got[3] == (1, float("inf"))


def test_messages_in_order(spark):
    rows = spark.createDataFrame(
        [(1, 3, "2026-01-02"), (2, 1, "2026-01-01"), (1, 2, "2026-01-02"), (1, 9, "2026-01-01")],
        "doc_id bigint, message_id int, created_at string")
    assert [r.message_id for r in changes.chat_history(rows, 1).collect()] == [9, 2, 3]
