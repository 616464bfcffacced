"""One named query per operator, over the given tables."""

from __future__ import annotations

from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerleaf.functions.values import parse_date, parse_num
from ledgerleaf.operators import assistant, changes, classify, exports, extract, passages
from ledgerleaf.operators import portfolio, search, validate
from ledgerleaf.operators.insights import add_insights, insights_long
from ledgerleaf.plans import daily, dashboard, pipeline, warehouse
from ledgerleaf.plans.table import VERSION, DocumentTable
from ledgerleaf.rules import audit as audit_rules
from ledgerleaf.rules import categories as C
from ledgerleaf.rules import passages as passage_rules
from ledgerleaf.session import shared_dir
from ledgerleaf.sources import corpus as corpora
from ledgerleaf.sources import files, pages
from ledgerleaf.sources.tables import table
from ledgerleaf.streaming.ingest import ingest_stream, merge_batch, upsert_stream

AS_OF = "1999-01-01"
QUESTION = "Where do the invoice supplier and the passport number stand in that?"
QUERIES: dict = {}


def query(function):
    """Register a query under its name."""
    QUERIES[function.__name__] = function
    return function


def plan(function):
    """Build a plan once per session and data folder; only the plan is kept, never its rows."""
    return wraps(function)(lru_cache(maxsize=8)(function))


# --- shared plans ---------------------------------------------------------------------------

@plan
def raw(spark, sf_dir):
    """Every uploaded document, files of extensions that are not accepted included."""
    return corpora.corpus(spark, sf_dir, deal=False).unionByName(corpora.rejects(spark, sf_dir))


@plan
def docs(spark, sf_dir):
    return pipeline.accepted(corpora.corpus(spark, sf_dir))


@plan
def listed(spark, sf_dir):
    """The same documents where ids, names and times are asked for, no texts: their rows stay where they are."""
    return pipeline.accepted(corpora.corpus(spark, sf_dir, deal=False))


@plan
def kind(spark, sf_dir, name):
    return pipeline.accepted(getattr(corpora, name)(spark, sf_dir))


@plan
def tables(spark, sf_dir):
    return corpora.invoice_tables(spark, sf_dir)


@plan
def texts(spark, sf_dir):
    return pipeline.prepare(docs(spark, sf_dir)).drop("first_page")


@plan
def classified(spark, sf_dir):
    return classify.classify(texts(spark, sf_dir))


@plan
def understood(spark, sf_dir, name=None, defaults="reference", keys=None, category=None):
    source = kind(spark, sf_dir, name) if name else docs(spark, sf_dir)
    return pipeline.understand(source, defaults, keys, category)


@plan
def audited(spark, sf_dir, name=None, defaults="reference"):
    source = kind(spark, sf_dir, name) if name else docs(spark, sf_dir)
    return pipeline.audit(source, tables(spark, sf_dir), defaults, AS_OF)


@plan
def advised(spark, sf_dir, name=None):
    return add_insights(audited(spark, sf_dir, name))


@plan
def edits(spark, sf_dir):
    """New payment terms for urgent orders; a field that no invoice has for high ones."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    ).select(
        (F.col("o_orderkey") * 8).alias("doc_id"),
        F.when(urgent, "grand_total").otherwise("cost_center").alias("key"),
        F.when(urgent, F.format_number("o_totalprice", 2)).otherwise("4812").alias("value"),
        F.col("o_orderkey").alias("edit_no"),
    ).withColumn("value", F.concat(F.lit("  "), "value", F.lit("\n")))


@plan
def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@plan
def turn_pages(spark, sf_dir):
    """Conversations as documents, their turns as pages."""
    return turns(spark, sf_dir).select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        "text",
    )


def kept(rows, name):
    """Rows written to a fresh shared folder and read from there, where a query reads the outcome of text work more than once."""
    folder = shared_dir(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- sources and sinks ----------------------------------------------------------------------

@query
def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as text files, one per document, read back."""
    folder = shared_dir(spark, "text-files")
    files.write_text_files(table(spark, sf_dir, "documents"), folder)
    read = files.read_text_files(spark, f"{folder}/*")
    return read.select(
        F.regexp_extract("file_path", r"/(-?\d+)_\d+\.txt$", 1).try_cast("long").alias("doc_id"), "text"
    )


@query
def scan_pages(spark, sf_dir):
    """The conversation turns as JSON pages, read back."""
    folder = shared_dir(spark, "json-pages")
    turn_pages(spark, sf_dir).withColumns({
        "tables": F.array(F.array(F.array(F.lit("turn")))),
        "width": F.lit(612.0), "height": F.lit(792.0),
    }).write.json(folder)
    return files.read_pages(spark, folder).select(
        "doc_id", "page_number", "text", F.size("tables").alias("tables"), "width", "height"
    )


@query
def assemble_pages(spark, sf_dir):
    return pages.assemble(turn_pages(spark, sf_dir))


@query
def split_pages(spark, sf_dir):
    return pages.split_pages(pages.assemble(turn_pages(spark, sf_dir)))


@query
def page_count(spark, sf_dir):
    return pages.page_count(
        table(spark, sf_dir, "documents").select("doc_id"), turn_pages(spark, sf_dir)
    )


@query
def ingest_filter(spark, sf_dir):
    name = F.col("original_name")
    return raw(spark, sf_dir).select(
        "doc_id", "original_name",
        pipeline.extension(name).alias("extension"),
        pipeline.extension(name).isin(*pipeline.EXTENSIONS).alias("accepted"),
    )


@query
def empty_text_fill(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", "text")


@query
def upsert_latest(spark, sf_dir):
    """Events as versions of their user's record."""
    versions = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), "event_type", "value", "event_id",
        F.struct("ts", "event_id").alias("version"),
    )
    return changes.latest(versions).drop("version")


@query
def apply_edits(spark, sf_dir):
    fields = extract.fields_long(understood(spark, sf_dir))
    return changes.apply_edits(fields, edits(spark, sf_dir)).select(
        "doc_id", "field_ord", "key", "value", "label"
    )


@query
def cascade_delete(spark, sf_dir):
    """What is left of three tables after deleting every document in error."""
    severities = F.transform("issues", lambda i: i["severity"]).alias("severities")
    checked = kept(audited(spark, sf_dir).select("doc_id", severities), "checked")
    issues = checked.select("doc_id", F.explode("severities").alias("severity"))
    left = changes.cascade_delete(
        {
            "documents": checked.select("doc_id"),
            "intelligence": issues.select("doc_id"),
            "chat_messages": turns(spark, sf_dir).select((F.col("conv_id") * 8).alias("doc_id")),
        },
        checked.where(F.array_contains("severities", "error")).select("doc_id"),
    )
    parts = [
        rows.agg(F.count("*").alias("rows_left"), F.sum("doc_id").alias("id_sum"))
        .select(F.lit(name).alias("table_name"), "rows_left", "id_sum")
        for name, rows in left.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def chat_append(spark, sf_dir):
    """Paired turns of the conversations as stored chat rows."""
    pairs = changes.chat_pairs(turns(spark, sf_dir)).withColumn(
        "citations", F.array().cast(assistant.CITATION_TYPE))
    return changes.chat_rows(pairs).select(
        "conv_id", "turn", "turn_ord", "role", "message",
        F.to_json("citations").alias("citations"),
    )


@query
def export_json(spark, sf_dir):
    return exports.export_json(extract.with_nested_items(advised(spark, sf_dir), tables(spark, sf_dir)))


@query
def export_fields(spark, sf_dir):
    return exports.export_fields(extract.fields_long(understood(spark, sf_dir)))


@query
def export_items(spark, sf_dir):
    return exports.export_items(line_items(spark, sf_dir))


@query
def export_json_read(spark, sf_dir):
    """The JSON texts read back into columns."""
    items = "array<struct<description string, quantity string, unit_price string, total string>>"
    schema = (f"export_metadata struct<document_id bigint, filename string, category string, validation_status string, processed_at string>, "
              f"extracted_fields map<string, string>, line_items {items}, validation_issues array<struct<code string>>, knowledge_insights array<struct<title string>>")
    read = export_json(spark, sf_dir).select("doc_id", F.from_json("json", schema).alias("x")).select("doc_id", "x.*")
    return read.select(
        "doc_id", "export_metadata.document_id", "export_metadata.filename", "export_metadata.category", "export_metadata.validation_status", "export_metadata.processed_at",
        F.size("extracted_fields").alias("fields_count"), F.element_at("extracted_fields", F.lit("grand_total")).alias("grand_total"),
        F.array_join(F.transform("line_items", lambda i: i["total"]), "|").alias("item_totals"),
        F.array_join(F.transform("validation_issues", lambda i: i["code"]), "|").alias("codes"), F.size("knowledge_insights").alias("insights_count"))


@query
def export_csv(spark, sf_dir):
    """Fields and line items written as CSV files and read back, items with their place."""
    known = kept(understood(spark, sf_dir).select("doc_id", "category", "fields"), "understood")
    rows = {"fields": exports.export_fields(extract.fields_long(known)),
            "items": exports.export_items_ordered(extract.with_default_items(extract.line_items_from_tables(tables(spark, sf_dir)), known))}
    read = {}
    for name, part in rows.items():
        folder = shared_dir(spark, f"csv-{name}")
        exports.write_csv(part, folder)
        read[name] = exports.read_csv(spark, folder, part.schema)
    headings = [F.col(f"`{h}`").alias(n) for h, n in zip(exports.FIELD_HEADINGS, ("a", "b", "c"))]
    fields = read["fields"].select(F.lit("fields").alias("part"), "doc_id", F.lit(0).alias("page_number"), F.lit(0).alias("table_ord"), F.col("field_ord").alias("ord"), *headings)
    items = read["items"].select(F.lit("items").alias("part"), "doc_id", "page_number", "table_ord", F.col("item_ord").alias("ord"),
                                 *(F.col(f"`{h}`").alias(n) for h, n in zip(exports.ITEM_HEADINGS[:2] + exports.ITEM_HEADINGS[3:], ("a", "b", "c"))))
    return fields.unionByName(items)


@query
def json_decode(spark, sf_dir):
    """Fields and issues to JSON text and back."""
    stored = exports.encode_nested(
        audited(spark, sf_dir).select("doc_id", "fields", "issues"),
        ("fields", "issues"),
    )
    typed = exports.decode_nested(
        stored,
        {"fields": extract.FIELD_TYPE, "issues": f"array<{validate.ISSUE_TYPE}>"},
    )
    return typed.select(
        "doc_id", F.size("issues").alias("issues_count"), F.explode("fields").alias("f")
    ).select("doc_id", "issues_count", "f.key", "f.value", "f.confidence", "f.label")


# --- filters, search and joins --------------------------------------------------------------

def _summary(rows):
    return rows.select("doc_id", "original_name", "category", "validation_status")


@query
def filter_category(spark, sf_dir):
    return _summary(search.filter_category(audited(spark, sf_dir), "legal CONTRACT"))


@query
def filter_status(spark, sf_dir):
    return _summary(search.filter_status(audited(spark, sf_dir), "ERROR"))


@query
def search_docs(spark, sf_dir):
    return _summary(search.search(audited(spark, sf_dir), "Bill"))


@query
def search_docs_wide(spark, sf_dir):
    return _summary(search.search_wide(audited(spark, sf_dir), " Warning "))


@query
def status_bucket(spark, sf_dir):
    return _summary(search.status_tab(audited(spark, sf_dir), "warning"))


@query
def filter_user(spark, sf_dir):
    return _summary(search.filter_user(audited(spark, sf_dir), 3))


def _intelligence(checked):
    return checked.select("doc_id", "category", "validation_status", "fields", "issues")


def _joined(rows):
    return rows.select(
        "doc_id", "original_name", "category", "validation_status",
        F.size("fields").alias("fields_count"), F.size("issues").alias("issues_count"),
    )


@query
def docs_left_intel(spark, sf_dir):
    """Every uploaded document, rejected ones included, with what is known about it."""
    return _joined(search.with_intelligence(
        raw(spark, sf_dir).select("doc_id", "original_name"),
        _intelligence(audited(spark, sf_dir)),
    ))


@query
def doc_by_id(spark, sf_dir):
    return _joined(search.by_id(
        raw(spark, sf_dir).select("doc_id", "original_name"),
        _intelligence(audited(spark, sf_dir)),
        56 * 8,
    ))


def _requests(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 8).alias("doc_id"))
    return orders.unionByName(corpora.rejects(spark, sf_dir).select("doc_id"))


@query
def known_docs(spark, sf_dir):
    return search.known(_requests(spark, sf_dir), listed(spark, sf_dir))


@query
def unknown_docs(spark, sf_dir):
    return search.unknown(_requests(spark, sf_dir), listed(spark, sf_dir))


# --- portfolio ------------------------------------------------------------------------------

@query
def dashboard_kpis(spark, sf_dir):
    return portfolio.dashboard_kpis(audited(spark, sf_dir))


@query
def category_counts(spark, sf_dir):
    return portfolio.category_counts(classified(spark, sf_dir))


@query
def category_share(spark, sf_dir):
    return portfolio.category_share(classified(spark, sf_dir))


@query
def total_anomalies(spark, sf_dir):
    return portfolio.total_anomalies(audited(spark, sf_dir))


@query
def vendor_frequency(spark, sf_dir):
    return portfolio.vendor_frequency(understood(spark, sf_dir, keys=portfolio.COUNTERPARTY_KEYS)).select("name", "frequency")


@query
def top_vendors(spark, sf_dir):
    return portfolio.top_vendors(understood(spark, sf_dir, keys=portfolio.COUNTERPARTY_KEYS))


@query
def urgent_risks(spark, sf_dir):
    return portfolio.urgent_risks(audited(spark, sf_dir))


@query
def deadlines(spark, sf_dir):
    return portfolio.deadlines(understood(spark, sf_dir, keys=portfolio.DEADLINE_KEYS))


@query
def deadlines_by_date(spark, sf_dir):
    return portfolio.deadlines(understood(spark, sf_dir, keys=portfolio.DEADLINE_KEYS), by_date=True)


@query
def docs_recent(spark, sf_dir):
    return search.newest_first(listed(spark, sf_dir)).select(
        "doc_id", "original_name", stamp("created_at"))


@query
def recent_docs(spark, sf_dir):
    """The newest documents are found by time and id, which need no text work; only these are checked, with their own order lines."""
    newest = kept(search.newest_first(listed(spark, sf_dir)).limit(portfolio.RECENT), "newest")
    lines = tables(spark, sf_dir).join(F.broadcast(newest.select("doc_id")), "doc_id", "left_semi")
    return portfolio.recent_documents(pipeline.audit(newest, lines, as_of=AS_OF)).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query
def chat_history(spark, sf_dir):
    """Events as a message log."""
    messages = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("message_id"),
        F.col("event_type").alias("message"), F.col("ts").alias("created_at"),
    )
    return changes.chat_history(messages).select(
        "doc_id", "message_id", "message", stamp("created_at"))


@query
def chat_pairs(spark, sf_dir):
    return changes.chat_pairs(turns(spark, sf_dir))


@query
def line_sum(spark, sf_dir):
    return validate.line_totals(extract.line_items_from_tables(tables(spark, sf_dir)))


@query
def doc_counts(spark, sf_dir):
    return audited(spark, sf_dir).select(
        "doc_id", F.size("fields").alias("fields_count"), "issues_count")


# --- classifier -----------------------------------------------------------------------------

def _points(spark, sf_dir, total):
    hay = classify.with_haystack(texts(spark, sf_dir))
    pairs = F.array(*(
        F.struct(F.lit(c.name).alias("category"), total(c).alias("points"))
        for c in C.CATEGORIES
    ))
    return hay.select("doc_id", F.inline(pairs))


@query
def keyword_scores(spark, sf_dir):
    return _points(spark, sf_dir, classify.keyword_total)


@query
def pattern_scores(spark, sf_dir):
    return _points(spark, sf_dir, classify.pattern_total)


@query
def category_scores(spark, sf_dir):
    return classify.scores_long(texts(spark, sf_dir))


@query
def classify_docs(spark, sf_dir):
    return classified(spark, sf_dir).select(
        "doc_id", "category", "category_confidence", "best_score")


@query
def classify_fallback(spark, sf_dir):
    """Most free texts leave the decision to the file name."""
    return classified(spark, sf_dir).select(
        "doc_id", "original_name", "category", "category_confidence",
        (F.col("best_score") < C.WEAK_SCORE).alias("weak"),
    )


# --- extraction -----------------------------------------------------------------------------

#: Categories with rules of their own, by the end of their queries' names; None stands for all others.
SLUGS = {"invoice": C.INVOICE, "contract": C.CONTRACT, "audit": C.AUDIT, "identity": C.IDENTITY,
         "generic": None}


def in_category(category):
    if category:
        return F.col("category") == category
    return ~F.col("category").isin(*(c for c in SLUGS.values() if c))


def _fields(category):
    def run(spark, sf_dir):
        return extract.fields_long(understood(spark, sf_dir, category=category).where(in_category(category))).select(
            "doc_id", "category", "field_ord", "key", "value", "is_default")

    return run


for _slug, _category in SLUGS.items():
    QUERIES[f"fields_{_slug}"] = _fields(_category)


@query
def fields_long(spark, sf_dir):
    return extract.fields_long(understood(spark, sf_dir))


@query
def extraction_coverage(spark, sf_dir):
    return extract.extraction_coverage(understood(spark, sf_dir, None, "null"))


@query
def line_items(spark, sf_dir):
    items = extract.line_items_from_tables(tables(spark, sf_dir))
    return extract.with_default_items(items, classified(spark, sf_dir))


# --- entities and sections ------------------------------------------------------------------

def _matches(spark, sf_dir, rule):
    return texts(spark, sf_dir).select(
        "doc_id",
        F.posexplode(passages.found(F.col("text"), rule)).alias("match_ord", "value"),
    )


@query
def entities_money(spark, sf_dir):
    return _matches(spark, sf_dir, passage_rules.ENTITIES[0])


@query
def entities_date(spark, sf_dir):
    return _matches(spark, sf_dir, passage_rules.ENTITIES[1])


@query
def entities_id(spark, sf_dir):
    return _matches(spark, sf_dir, passage_rules.ENTITIES[2])


@query
def entities_email(spark, sf_dir):
    return _matches(spark, sf_dir, passage_rules.ENTITIES[3])


@plan
def entitied(spark, sf_dir):
    return passages.extract_entities(texts(spark, sf_dir))


@query
def entities(spark, sf_dir):
    return passages.entities_long(entitied(spark, sf_dir)).drop("span")


@query
def entity_spans(spark, sf_dir):
    """Spans of all entities, with the text they cover, which is cut out before there is a row for each."""
    found = passages.extract_entities(texts(spark, sf_dir), caps=None)

    def covered(e):
        start, end = e["span"][0], e["span"][1]
        return F.struct(e["type"], e["value"], start.alias("span_start"), end.alias("span_end"),
                        F.substring(F.col("text"), start + 1, end - start).alias("covered"))

    return found.select("doc_id", F.inline(F.transform("entities", covered)))


@query
def entity_pages(spark, sf_dir):
    """Entities of conversations as paged documents, with the page each stands on."""
    assembled = pages.with_page_starts(pages.assemble(turn_pages(spark, sf_dir)).select("doc_id", "text"))
    found = passages.extract_entities(assembled, caps=None)

    def placed(e):
        start, end = e["span"][0], e["span"][1]
        return F.struct(e["type"], e["value"], start.alias("span_start"), end.alias("span_end"), pages.page_at(start).alias("page_number"))

    return found.select("doc_id", F.inline(F.transform("entities", placed)))


@query
def entities_all(spark, sf_dir):
    """Every entity of every document, without the cap of the reference."""
    return passages.entities_long(passages.extract_entities(texts(spark, sf_dir), caps=None)).drop("span")


@query
def sections_all(spark, sf_dir):
    return passages.sections_long(passages.extract_sections(texts(spark, sf_dir), caps=None))


@query
def snippets_all(spark, sf_dir):
    return assistant.snippet_search(texts(spark, sf_dir), QUESTION, caps=None)


@query
def entities_distinct(spark, sf_dir):
    return passages.distinct_entities(passages.all_matches(texts(spark, sf_dir)))


@query
def entity_totals(spark, sf_dir):
    return passages.entity_totals(texts(spark, sf_dir))


@query
def doc_lines(spark, sf_dir):
    return passages.doc_lines(texts(spark, sf_dir)).drop("is_heading")


@query
def section_headers(spark, sf_dir):
    rows = passages.doc_lines(texts(spark, sf_dir))
    return rows.where("is_heading").select("doc_id", "line_no", "line")


@query
def sections(spark, sf_dir):
    return passages.sections_long(passages.extract_sections(texts(spark, sf_dir)))


# --- scalar readings ------------------------------------------------------------------------

@query
def parse_num_cells(spark, sf_dir):
    """Cells of the invoice tables and page addresses as numbers."""
    cells = tables(spark, sf_dir).select(F.explode(F.element_at("rows", -1)).alias("cell"))
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("cell"))
    return cells.unionByName(urls).where(F.col("cell").isNotNull()).groupBy("cell").agg(
        F.count("*").alias("n")
    ).withColumn("number", parse_num(F.col("cell")))


@query
def parse_date_cells(spark, sf_dir):
    """Order dates in eight spellings, and page addresses, which are no dates."""
    key = F.col("o_orderkey")
    spelled = table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" "), corpora.spelled_date(F.col("o_orderdate"), key)).alias("cell"))
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("cell"))
    return spelled.unionByName(urls).groupBy("cell").agg(F.count("*").alias("n")).withColumn(
        "day", F.date_format(parse_date(F.col("cell")), "yyyy-MM-dd"))


# --- validation and insights ----------------------------------------------------------------

@query
def issue_messages(spark, sf_dir):
    return validate.issues_long(audited(spark, sf_dir))


@query
def validate_docs(spark, sf_dir):
    return audited(spark, sf_dir).select(
        "doc_id", "category", "issues_count", "validation_score", "validation_status",
        "is_approved",
    )


@query
def validation_score(spark, sf_dir):
    return audited(spark, sf_dir).select("doc_id", "validation_score")


@query
def validation_status(spark, sf_dir):
    return audited(spark, sf_dir).groupBy("category", "validation_status").agg(
        F.count("*").alias("documents"))


def _rule(code, category):
    """Issues of one rule: of documents of its category, under the rules up to it. Order lines are summed for the one rule
    that compares them."""
    def run(spark, sf_dir):
        rows = understood(spark, sf_dir, category=category).drop("text", "first_page")
        if code == "LINE_ITEM_MISMATCH":
            rows = validate.with_line_totals(rows, tables(spark, sf_dir))
        checked = validate.validate(rows, AS_OF, validate.rules_before(code))
        return validate.issues_long(checked).where(F.col("code") == code)

    return run


for _issue in audit_rules.CATEGORY_ISSUES:
    QUERIES[f"rule_{_issue.code.lower()}"] = _rule(_issue.code, _issue.category)


@query
def rule_missing_field(spark, sf_dir):
    """With defaults='null' a field that is not found is missing. Issues of fields come before those of rules, which need not be looked at."""
    checked = validate.validate(understood(spark, sf_dir, None, "null").drop("text", "first_page"), AS_OF, ())
    return validate.issues_long(checked).where(F.col("code") == "MISSING_FIELD")


@query
def rule_low_confidence(spark, sf_dir):
    """Imported fields whose confidence was lowered by a tenth."""
    lowered = understood(spark, sf_dir).drop("text", "first_page").withColumn(
        "fields",
        F.transform(
            "fields", lambda f: f.withField("confidence", F.round(f["confidence"] - 0.1, 2))),
    )
    checked = validate.validate(lowered, AS_OF, ())
    return validate.issues_long(checked).where(F.col("code") == "LOW_CONFIDENCE")


def _insights(category):
    def run(spark, sf_dir):
        if category == C.INVOICE:
            return insights_long(advised(spark, sf_dir).where(in_category(category)))
        # Order lines belong to invoices alone.
        read = understood(spark, sf_dir, category=category).drop("text", "first_page").where(in_category(category))
        return insights_long(add_insights(validate.validate(validate.with_line_totals(read), AS_OF)))

    return run


for _slug, _category in SLUGS.items():
    QUERIES[f"insights_{_slug}"] = _insights(_category)


# --- questions ------------------------------------------------------------------------------

@query
def question_intent(spark, sf_dir):
    said = turns(spark, sf_dir).where(F.col("role") == "user")
    return said.select(
        "conv_id", "turn", assistant.question_intent(F.col("text")).alias("intent"))


@query
def snippet_search(spark, sf_dir):
    return assistant.snippet_search(texts(spark, sf_dir), QUESTION)


ASKED = (
    "What is the total amount and tax?", "When is the deadline?", "Which risks were found?",
    "Summarize this for me", "Who is the vendor?", "Where is the passport office?",
    "List hazard and osha rules", "Hm?",
)


def _answers(spark, sf_dir, caps):
    processed = kept(pipeline.process(docs(spark, sf_dir), tables(spark, sf_dir), as_of=AS_OF).select(*assistant.ANSWER_INPUTS), "processed")
    asked = listed(spark, sf_dir).select(
        F.col("doc_id").alias("question_id"), "doc_id",
        corpora.pick(F.floor(F.col("doc_id") / 8) + F.col("doc_id"), ASKED).alias("question"),
    )
    return assistant.answer_batch(asked, processed, caps).withColumn(
        "citations",
        F.array_join(F.transform(
            "citations", lambda c: F.concat_ws("|", c["section"], c["page"], c["field"])), "\n"),
    )


@query
def answer_batch(spark, sf_dir):
    """One question per document, by turns, answered from the whole pipeline."""
    return _answers(spark, sf_dir, "reference")


@query
def answer_all(spark, sf_dir):
    """The same, with every matching line quoted."""
    return _answers(spark, sf_dir, None)


# --- pipelines ------------------------------------------------------------------------------

def _counts(processed):
    return processed.select(
        "doc_id", "category", "category_confidence", "validation_status", "validation_score",
        *(F.size(c).alias(f"{c}_count") for c in (
            "fields", "sections", "entities", "issues", "insights")),
    )


@query
def process_batch(spark, sf_dir):
    return _counts(pipeline.process(docs(spark, sf_dir), tables(spark, sf_dir), as_of=AS_OF))


@query
def process_incremental(spark, sf_dir):
    """Documents that are not among the labelled texts, which count as stored already."""
    stored = table(spark, sf_dir, "labels").select((F.col("doc_id") * 8 + 5).alias("doc_id"))
    fresh = warehouse.new_only(docs(spark, sf_dir), stored)
    return _counts(pipeline.process(fresh, tables(spark, sf_dir), as_of=AS_OF))


@query
def process_stream(spark, sf_dir):
    """The free texts as a file stream, processed into a stored table."""
    schema = table(spark, sf_dir, "documents").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    out = shared_dir(spark, "stream-out")
    ingest_stream(
        corpora.name_texts(arriving), out, shared_dir(spark, "stream-state"),
        lambda rows: pipeline.process(rows, as_of=AS_OF),
    ).awaitTermination()
    return _counts(spark.read.parquet(out))


@query
def reprocess(spark, sf_dir):
    """Labelled texts run through the whole pipeline again and replace their stored rows."""
    everything = docs(spark, sf_dir)
    again = search.known(
        everything, table(spark, sf_dir, "labels").select(
            (F.col("doc_id") * 8 + 5).alias("doc_id")))
    done = _counts(pipeline.process(again, as_of=AS_OF)).withColumns({
        "state": F.lit("reprocessed"), "version": F.lit(1)})
    stored = everything.select(
        "doc_id", F.lit("stored").alias("state"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in done.schema
          if f.name not in ("doc_id", "state", "version")))
    return changes.upsert(stored, done)


@query
def recompute(spark, sf_dir):
    """Invoices of urgent orders after their total was edited."""
    done = changes.recompute(audited(spark, sf_dir, "invoices"), edits(spark, sf_dir), AS_OF)
    return done.select(
        "doc_id", "validation_score", "validation_status", "issues_count",
        F.size("insights").alias("insights_count"),
    )


# --- the stored table -----------------------------------------------------------------------

def _table(spark, name):
    return DocumentTable(spark, shared_dir(spark, name))


def _saved(checked):
    """What a stored document holds for lookups, edits and the rules."""
    return checked.select(
        "doc_id", "original_name", "created_at", "user_id", "category", "category_confidence", "fields", "line_count", "line_sum",
        "issues", "issues_count", "validation_score", "validation_status", "is_approved")


@query
def append_documents(spark, sf_dir):
    """Pages appended to a stored table as documents: the id comes from the url, the type is the default one."""
    folder = shared_dir(spark, "appended")
    rows = table(spark, sf_dir, "pages").select(
        F.xxhash64("url").alias("doc_id"), F.col("url").alias("original_name"),
        F.length("html").cast("long").alias("file_size"), F.lit("uploads").alias("category"),
        F.when(F.col("page_id") % 2 == 0, "text/html").alias("mime_type"))
    warehouse.store(rows, folder)
    return warehouse.load(spark, folder).groupBy("category", "mime_type").agg(
        F.count("*").alias("documents"), F.sum("file_size").alias("file_size"), F.count_distinct("doc_id").alias("ids"))


def _changed_store(spark, sf_dir, figures=None):
    """Every document saved, some saved anew (twice, and once too late), totals edited, what is in error deleted."""
    store = DocumentTable(spark, shared_dir(spark, "store-merge"), figures=figures)
    store.create(_saved(audited(spark, sf_dir)))
    medium = table(spark, sf_dir, "orders").where("o_orderpriority = '3-MEDIUM'").select((F.col("o_orderkey") * 8).alias("doc_id"))

    def renamed(prefix, version):
        rows = store.known(medium)
        return rows.withColumns({"original_name": F.concat(F.lit(prefix), "original_name"), VERSION: F.lit(version).cast("long")})

    late = shared_dir(spark, "late")  # written down before the table it is read from changes
    renamed("late-", 1).write.parquet(late)
    store.merge(renamed("older-", 1).unionByName(renamed("again-", 2)), batch=1)
    store.merge(spark.read.parquet(late), batch=2)
    store.edit(edits(spark, sf_dir), version=3, batch=3, as_of=AS_OF)
    store.delete(store.load().where("validation_status = 'error'"), version=4, batch=4)
    return store


@query
def store_merge(spark, sf_dir):
    """What a stored table holds after a series of changes."""
    return _changed_store(spark, sf_dir).load().select("doc_id", "original_name", "category", "validation_status", "validation_score", "issues_count")


@query
def dashboard_incremental(spark, sf_dir):
    """The figures after the same changes, from what each of them added and took away."""
    figures = shared_dir(spark, "figures")
    _changed_store(spark, sf_dir, figures)
    return dashboard.figures(spark, figures).select("kind", "name", "n", F.col("amount").cast("double").alias("amount"))


@query
def store_lookup(spark, sf_dir):
    """One document of the stored table, from its bucket alone."""
    store = _table(spark, "store-lookup")
    store.create(_saved(audited(spark, sf_dir)))
    return _joined(store.lookup(56 * 8))


@query
def stream_upsert(spark, sf_dir):
    """The whole corpus in two arrivals, invoices in both, and the second arrival once more."""
    store, landing, state = _table(spark, "store-stream"), shared_dir(spark, "landing"), shared_dir(spark, "stream-state")
    everything = docs(spark, sf_dir)
    invoice = F.col("doc_id") % 8 == 0
    draft = everything.withColumns({"text": F.when(invoice, "draft").otherwise(F.col("text")), VERSION: F.lit(1).cast("long")})
    final = everything.where(invoice).withColumn(VERSION, F.lit(2).cast("long"))

    def step(rows):
        return pipeline.process(rows, tables(spark, sf_dir), as_of=AS_OF)

    def run():
        upsert_stream(spark.readStream.schema(draft.schema).parquet(landing), store, state, step).awaitTermination()

    store.create(step(draft.limit(0).drop(VERSION)))
    draft.write.mode("append").parquet(landing)
    run()
    final.write.mode("append").parquet(landing)
    run()
    merge_batch(final, 1, store, step)
    return _counts(store.load())


@plan
def _by_day(spark, sf_dir):
    """Folder of the checked documents by day, written once a session."""
    folder = shared_dir(spark, "by-day")
    daily.store_by_day(_saved(audited(spark, sf_dir)), folder)
    return folder


@query
def urgent_risks_recent(spark, sf_dir):
    return daily.newest(spark, _by_day(spark, sf_dir), portfolio.urgent_risks, portfolio.TOP_RISKS)


@query
def deadlines_recent(spark, sf_dir):
    return daily.newest(spark, _by_day(spark, sf_dir), portfolio.deadlines, portfolio.TOP_DEADLINES)


@query
def recent_docs_daily(spark, sf_dir):
    found = daily.newest(spark, _by_day(spark, sf_dir), portfolio.recent_documents, portfolio.RECENT)
    return found.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
