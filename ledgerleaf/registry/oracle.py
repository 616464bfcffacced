"""The same questions as SQL for a second engine, written independently of the Spark operators.

The texts and rule data are shared; the logic is stated again as relational SQL: one row per field,
issue and line instead of nested columns, groupings instead of per-row folds.
"""

from __future__ import annotations

import re
from string import Formatter

from ledgerleaf.functions.patterns import WHITESPACE, spell
from ledgerleaf.functions.values import MONTH_NAMES
from ledgerleaf.plans import pipeline
from ledgerleaf.registry.queries import AS_OF, ASKED, QUESTION, SLUGS
from ledgerleaf.rules import assistant as Q
from ledgerleaf.rules import audit as A
from ledgerleaf.rules import categories as C
from ledgerleaf.rules import fields as X
from ledgerleaf.rules import insights as K
from ledgerleaf.rules import passages as P
from ledgerleaf.sources import corpus as S

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str, ignore_case: bool = True) -> str:
    return text(("(?i)" if ignore_case else "") + spell(pattern, boundary=r"\b"))


def strip(sql: str) -> str:
    return f"trim({sql}, {text(WHITESPACE)})"


def first_line(sql: str) -> str:
    return strip(f"string_split({strip(sql)}, chr(10))[1]")


def fill(template: str, **values: str) -> str:
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if name is not None:
            parts.append(f"coalesce(CAST({values[name]} AS VARCHAR), 'None')")
    return "(" + " || ".join(parts) + ")"


def money(sql: str) -> str:
    return f"format('{{:,.2f}}', CAST({sql} AS DOUBLE))"


def exact(sql: str, digits: int = 2) -> str:
    return f"CAST(format('{{:.{digits}f}}', CAST({sql} AS DOUBLE)) AS DOUBLE)"


def parse_num(sql: str) -> str:
    return f"coalesce(try_cast(regexp_replace({sql}, '[^\\d.]', '', 'g') AS DOUBLE), 0.0)"


DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%B %d, %Y", "%b %d, %Y",
                "%B %d %Y", "%b %d %Y")


def parse_date(sql: str) -> str:
    tries = ", ".join(f"try_strptime({strip(sql)}, '{f}')" for f in DATE_FORMATS)
    return f"CAST(coalesce({tries}) AS DATE)"


def any_of(sql: str, words) -> str:
    return "(" + " OR ".join(f"contains({sql}, {text(w)})" for w in words) + ")"


def pick(key: str, values, quote: bool = True) -> str:
    listed = ", ".join(text(v) if quote else v for v in values)
    return f"[{listed}][CAST(({key}) % {len(values)} AS INTEGER) + 1]"


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """Prefix the statement with the tables it refers to, and theirs."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\bx_\w+", body):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    tables = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in needed)
    return f"WITH {tables}\n{sql}"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = with_ctes(sql)


# --- rendered documents ---------------------------------------------------------------------

def spelled_date(day: str, key: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN strftime({day}, {text(f)})" for i, (_, f) in enumerate(S.DATE_SHAPES))
    return f"(CASE CAST(({key}) % {len(S.DATE_SHAPES)} AS INTEGER) {cases} END)"


def padded(key: str) -> str:
    return f"lpad(CAST({key} AS VARCHAR), 8, '0')"


def iso(day: str) -> str:
    return f"strftime({day}, '%Y-%m-%d')"


def plus_days(start: str, days: str) -> str:
    return f"(DATE '{start}' + CAST({days} AS INTEGER))"


def amount(cents: str) -> str:
    return money(f"({cents}) / 100.0")


def documents(rows: str, kind: str, key: str, created: str, body: str) -> str:
    names = {"text": S.TEXT_NAMES, "reject": S.REJECT_NAMES}.get(kind, S.FILE_NAMES)
    source = "source" if kind == "text" else "''"
    name = pick(key, [fill(n, key=key, kind=text(kind), source=source) for n in names], False)
    return f"""SELECT {key} * 8 + {S.KINDS.index(kind)} AS doc_id, {key} % 7 + 1 AS user_id,
  {name} AS original_name, CAST({created} AS TIMESTAMP) AS created_at, {body} AS text
FROM {rows}"""


cte("x_order_lines", """SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
  count(*) AS line_count, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY l_orderkey""")
cte("x_priced", """SELECT *, sub + tax + CASE WHEN o_orderkey % 7 = 0 THEN 90000 ELSE 0 END AS total
FROM (SELECT *, (sub + 5) // 10 AS tax FROM (
  SELECT o.o_orderkey, o.o_orderdate, CAST(o.o_orderdate AS DATE) AS day, l.line_count, l.s_suppkey,
    s.s_name, c.c_name, l.cents + CASE WHEN o.o_orderkey % 13 = 0 THEN 2500 ELSE 0 END AS sub
  FROM orders o JOIN x_order_lines l ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.s_suppkey))""")
_due = "(day + CAST(CASE WHEN o_orderkey % 17 = 0 THEN -5 ELSE 15 + o_orderkey % 46 END AS INTEGER))"
cte("x_invoices", documents(
    "x_priced", "invoice", "o_orderkey", "o_orderdate",
    "CASE WHEN o_orderkey % 97 = 5 THEN ' ' || chr(10) ELSE " + fill(
        S.INVOICE_TEXT,
        vendor="replace(s_name, '#', ' ')",
        customer="replace(c_name, '#', ' ')",
        number=padded("o_orderkey"),
        invoice_date=spelled_date("day", "o_orderkey"),
        due_line="CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE chr(10) || 'Due Date: ' || "
        + spelled_date(_due, "o_orderkey // 8") + " END",
        days="o_orderkey % 46 + 15",
        line_count="line_count",
        subtotal=amount("sub"),
        tax=amount("tax"),
        total="CASE WHEN o_orderkey % 19 = 0 THEN replace(" + amount("total")
        + ", ',', '') ELSE " + amount("total") + " END",
        supplier="s_suppkey",
    ) + " END"))
cte("x_contracts", documents(
    "(SELECT *, " + plus_days("1995-06-01", "s_suppkey * 37 % 900") + " AS effective FROM supplier)",
    "contract", "s_suppkey", "effective",
    fill(
        S.CONTRACT_TEXT,
        number="s_suppkey",
        vendor="replace(s_name, '#', ' ')",
        effective=spelled_date("effective", "s_suppkey"),
        expiration=spelled_date("(effective + 1000)", "s_suppkey + 3"),
        cap="CASE WHEN s_suppkey % 3 = 0 THEN 'Uncapped / Unlimited Indemnification' "
        "ELSE '$' || (s_suppkey % 9 + 1) || ',000,000' END",
        years="s_suppkey % 5 + 1",
        law="CASE WHEN s_suppkey % 4 = 0 THEN 'Not Specified (High Risk)' ELSE "
        + pick("s_nationkey", S.LAWS) + " END",
    )))
cte("x_audits", documents(
    "(SELECT *, " + plus_days("1998-06-01", "p_partkey * 11 % 200") + " AS day FROM part)",
    "audit", "p_partkey", "day",
    fill(
        S.AUDIT_TEXT,
        number=padded("p_partkey"), part="p_name", brand="replace(p_brand, '#', ' ')",
        type="p_type", audit_date=spelled_date("day", "p_partkey"), score="p_size + 45",
        status=pick("p_partkey", S.AUDIT_STATES), deadline=iso("(day + 30)"),
    )))
cte("x_identities", documents(
    "customer", "identity", "c_custkey", plus_days("1997-01-01", "c_custkey * 7 % 700"),
    fill(
        S.IDENTITY_TEXT,
        name=pick("c_custkey", S.FIRST_NAMES), segment="lower(c_mktsegment)",
        number=padded("c_custkey"), nationality=pick("c_nationkey", S.NATIONS),
        born=iso(plus_days("1950-01-01", "c_custkey * 29 % 14000")),
        expiry=iso(plus_days("1997-01-01", "c_custkey * 13 % 1500")), office="c_custkey % 40",
    )))
cte("x_claims", documents(
    "events", "claim", "event_id", "ts",
    fill(
        S.CLAIM_TEXT,
        user="user_id", number="event_id", amount=money("value"), type="event_type",
        day=iso("ts"),
    )))
cte("x_free", documents(
    "documents", "text", "doc_id", plus_days("1998-01-01", "doc_id % 900"), "text"))
KIND_TABLES = {"invoices": "x_invoices", "contracts": "x_contracts", "audits": "x_audits",
               "identities": "x_identities", "claims": "x_claims", "free_texts": "x_free"}
cte("x_rejects", documents(
    "nation", "reject", "CAST(n_nationkey AS BIGINT)", plus_days("1998-01-01", "n_nationkey"), "n_name"))
cte("x_raw", "\nUNION ALL ".join(f"SELECT * FROM {t}" for t in (*KIND_TABLES.values(), "x_rejects")))

_extension = "lower(regexp_extract(original_name, '[^./][^/]*?(\\.[^./]*)\\z', 1))"
_allowed = "(" + ", ".join(text(e) for e in pipeline.EXTENSIONS) + ")"
_before, _after = pipeline.EMPTY_TEXT
cte("x_docs", f"""SELECT doc_id, user_id, original_name, created_at, text AS first_page,
  CASE WHEN {strip('text')} = '' THEN {text(_before)} || original_name || {text(_after)}
  ELSE {strip('text')} END AS text
FROM x_raw WHERE {_extension} IN {_allowed}""")

# Line items: one page table per order line, its header row left out here.
cte("x_cells", """SELECT l_orderkey * 8 AS doc_id, l_linenumber AS page_number, l_suppkey AS table_ord,
  l_partkey % 50 = 0 AS short,
  'Part ' || l_partkey AS description, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity,
  format('{:,.2f}', l_extendedprice / l_quantity) AS unit_price,
  '$' || format('{:,.2f}', l_extendedprice) AS total FROM lineitem""")
cte("x_items", """SELECT doc_id, page_number, table_ord, 0 AS item_ord, description, quantity,
  unit_price, total FROM x_cells WHERE NOT short""")
cte("x_line_totals", f"""SELECT doc_id, count(*) AS line_count,
  CAST(sum(CAST({parse_num('total')} AS DECIMAL(28, 6))) AS DOUBLE) AS line_sum
FROM x_items GROUP BY doc_id""")

# --- classification -------------------------------------------------------------------------

cte("x_hay", "SELECT doc_id, lower(text || ' ' || original_name) AS hay FROM x_docs")


def keyword_points(category: C.Category) -> str:
    return " + ".join(
        f"least({C.KEYWORD_POINTS} * ((length(hay) - length(replace(hay, {text(w)}, ''))) "
        f"// {len(w)}), {C.KEYWORD_CEILING})" for w in category.keywords)


def pattern_points(category: C.Category) -> str:
    return " + ".join(
        f"least({C.PATTERN_POINTS} * len(regexp_extract_all(hay, {re2(p, False)})), "
        f"{C.PATTERN_CEILING})" for p in category.patterns)


cte("x_points", "\nUNION ALL ".join(
    f"SELECT doc_id, {text(c.name)} AS category, {i} AS ord, {c.weight_pct} AS weight, "
    f"CAST({keyword_points(c)} AS INTEGER) AS kw, CAST({pattern_points(c)} AS INTEGER) AS pat "
    "FROM x_hay" for i, c in enumerate(C.CATEGORIES)))
cte("x_scores", "SELECT doc_id, category, ord, (kw + pat) * weight / 100.0::DOUBLE AS score FROM x_points")
cte("x_best", """SELECT doc_id, category, score FROM x_scores
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1""")
_hints = " ".join(
    f"WHEN {any_of('lower(original_name)', words)} THEN {text(name)}"
    for words, name in C.FILENAME_HINTS)
_confidence = (
    f"least({C.CONFIDENCE_CEILING}::DOUBLE, greatest({C.CONFIDENCE_FLOOR}::DOUBLE, "
    f"{C.CONFIDENCE_BASE}::DOUBLE + b.score / (b.score + {C.CONFIDENCE_HALF}::DOUBLE) "
    f"* {C.CONFIDENCE_SPAN}::DOUBLE))")
cte("x_class", f"""SELECT *, CASE WHEN best_score >= {C.WEAK_SCORE} THEN {exact('strong')}
    WHEN category = {text(C.REPORT)} THEN {C.NO_HINT_CONFIDENCE}::DOUBLE
    ELSE {C.HINT_CONFIDENCE}::DOUBLE END AS category_confidence
FROM (SELECT d.*, b.score AS best_score, {_confidence} AS strong,
  CASE WHEN b.score >= {C.WEAK_SCORE} THEN b.category {_hints} ELSE {text(C.REPORT)} END AS category
FROM x_docs d JOIN x_best b USING (doc_id))""")

# --- fields ---------------------------------------------------------------------------------

def captures() -> str:
    selects = []
    named = ", ".join(text(c) for c in X.FIELDS)
    for category, rules in [*X.FIELDS.items(), (None, X.GENERIC_FIELDS)]:
        where = f"category = {text(category)}" if category else f"category NOT IN ({named})"
        for i, r in enumerate(rules):
            selects.append(
                f"SELECT doc_id, category, {i} AS field_ord, {text(r.key)} AS key, "
                f"{text(r.label)} AS label, {r.confidence}::DOUBLE AS confidence, {r.page} AS page, "
                f"{text(r.default)} AS dflt, regexp_extract(text, {re2(r.pattern)}, 1) AS raw "
                f"FROM x_class WHERE {where}")
    return "\nUNION ALL ".join(selects)


cte("x_captures", captures())
cte("x_heading", f"""SELECT doc_id, arg_min({strip('line')}, pos) AS heading FROM (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth
  FROM (SELECT doc_id, unnest(string_split(first_page, chr(10))) AS line,
      generate_subscripts(string_split(first_page, chr(10)), 1) AS pos
    FROM x_class WHERE category = {text(C.INVOICE)})
  WHERE {strip('line')} <> '')
WHERE nth <= {X.VENDOR_HEADING_LINES} AND length(line) > {X.VENDOR_MIN_LENGTH}
  AND NOT regexp_matches(line, {re2(X.NOT_A_VENDOR)})
GROUP BY doc_id""")
_vendor = next(r for r in X.FIELDS[C.INVOICE] if r.key == "vendor_name")


def fields(default: str) -> str:
    value = f"CASE WHEN raw = '' THEN {default} ELSE {first_line('raw')} END"
    unnamed = (f"key = 'vendor_name' AND heading IS NOT NULL AND "
               f"(raw = '' OR {first_line('raw')} = {text(_vendor.default)})")
    return f"""SELECT doc_id, category, field_ord, key, label, confidence, page,
  CASE WHEN {unnamed} THEN heading ELSE {value} END AS value,
  raw = '' AND NOT (key = 'vendor_name' AND heading IS NOT NULL) AS is_default
FROM x_captures LEFT JOIN x_heading USING (doc_id)"""


cte("x_fields", fields("dflt"))
cte("x_fields_null", fields("NULL"))


def wide(source: str) -> str:
    keys = [r.key for rules in X.FIELDS.values() for r in rules]
    columns = ", ".join(f"max(value) FILTER (WHERE key = '{k}') AS {k}" for k in keys)
    return f"SELECT doc_id, {columns} FROM {source} GROUP BY doc_id"


cte("x_wide", wide("x_fields"))

# --- issues ---------------------------------------------------------------------------------

_default_sum = sum(float(i[-1].replace(",", "")) for i in X.DEFAULT_LINE_ITEMS)


def readings(wide_table: str) -> str:
    def of(category, sql):
        return f"CASE WHEN c.category = {text(category)} THEN {sql} END"

    return f"""SELECT *, {exact('subtotal_n + tax_n')} AS expected_n, DATE '{AS_OF}' AS today FROM (
SELECT w.*, c.category, c.original_name, c.created_at, c.category_confidence, c.user_id,
  coalesce(t.line_count, {len(X.DEFAULT_LINE_ITEMS)}) AS line_count,
  coalesce(t.line_sum, {_default_sum}::DOUBLE) AS line_sum,
  {of(C.INVOICE, parse_date('invoice_date'))} AS invoice_d,
  {of(C.INVOICE, parse_date('due_date'))} AS due_d,
  {of(C.INVOICE, parse_num('subtotal'))} AS subtotal_n,
  {of(C.INVOICE, parse_num('tax_amount'))} AS tax_n,
  {of(C.INVOICE, parse_num('grand_total'))} AS total_n,
  {of(C.CONTRACT, parse_date('expiration_date'))} AS contract_d,
  {of(C.AUDIT, parse_date('corrective_deadline'))} AS deadline_d,
  {of(C.AUDIT, parse_num('compliance_score'))} AS score_n,
  {of(C.IDENTITY, parse_date('expiry_date'))} AS id_d
FROM {wide_table} w JOIN x_class c USING (doc_id) LEFT JOIN x_line_totals t USING (doc_id))"""


cte("x_read", readings("x_wide"))
CONDITIONS = {
    "DATE_INCONSISTENCY": "due_d < invoice_d",
    "INVOICE_OVERDUE": "due_d < today",
    "MATH_MISMATCH": "total_n > 0 AND subtotal_n > 0 AND abs(total_n - expected_n) > 0.05::DOUBLE",
    "LINE_ITEM_MISMATCH": "subtotal_n > 0 AND abs(line_sum - subtotal_n) > 1",
    "CONTRACT_EXPIRED": "contract_d < today",
    "HIGH_LEGAL_EXPOSURE": any_of("lower(governing_law)", A.UNKNOWN_LAW),
    "UNCAPPED_LIABILITY": any_of("lower(liability_cap)", A.OPEN_LIABILITY),
    "AUDIT_FAILURE": any_of("lower(status)", A.FAILED_AUDIT),
    "TIGHT_DEADLINE": "date_diff('day', today, deadline_d) <= 10",
    "ID_EXPIRED": "id_d < today",
    "ID_EXPIRING_SOON": "id_d >= today AND date_diff('day', today, id_d) < 30",
}
WORDING = {
    "due_date": "due_date", "invoice_date": "invoice_date", "expiration_date": "expiration_date",
    "corrective_deadline": "corrective_deadline", "expiry_date": "expiry_date",
    "days_overdue": "date_diff('day', due_d, today)",
    "total": money("total_n"), "subtotal": money("subtotal_n"), "tax": money("tax_n"),
    "expected": money("expected_n"), "delta": money("abs(total_n - expected_n)"),
    "line_sum": money("line_sum"), "score": "CAST(score_n AS VARCHAR)",
}


def issue_columns(rule: A.Issue, words: dict[str, str]) -> str:
    return (
        f"{text(rule.severity)} AS severity, {fill(rule.field, **words)} AS field, "
        f"{fill(rule.title, **words)} AS title, {fill(rule.message, **words)} AS message, "
        f"{text(rule.code)} AS code, {rule.penalty} AS penalty")


def category_issues(source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT doc_id, {100 + i} AS rank, {issue_columns(r, WORDING)} FROM {source} "
        f"WHERE category = {text(r.category)} AND {CONDITIONS[r.code]}"
        for i, r in enumerate(A.CATEGORY_ISSUES))


def field_issues(source: str, confidence: str = "confidence") -> str:
    words = {"key": "key", "label": "label",
             "percent": f"CAST(trunc({confidence} * 100) AS INTEGER)"}
    low, missing = A.FIELD_ISSUES
    empty = ", ".join(text(v) for v in A.MISSING_VALUES)
    return f"""SELECT doc_id, field_ord * 2 AS rank, {issue_columns(low, words)} FROM {source}
WHERE {confidence} < {A.LOW_CONFIDENCE}
UNION ALL SELECT doc_id, field_ord * 2 + 1 AS rank, {issue_columns(missing, words)} FROM {source}
WHERE coalesce({strip('value')}, '') IN ({empty})"""


def ranked_issues(body: str) -> str:
    return f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS INTEGER)
  AS issue_ord, severity, field, title, message, code, penalty FROM ({body})"""


cte("x_issues", ranked_issues(category_issues("x_read") + "\nUNION ALL " + field_issues("x_fields")))
cte("x_checked", """SELECT r.*, coalesce(i.n, 0) AS issues_count,
  CAST(greatest(0, 100 - coalesce(i.lost, 0)) AS INTEGER) AS validation_score,
  CASE WHEN i.worst = 2 THEN 'error' WHEN i.worst = 1 THEN 'warning' ELSE 'valid' END AS validation_status
FROM x_read r LEFT JOIN (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, sum(penalty) AS lost,
  max(CASE severity WHEN 'error' THEN 2 ELSE 1 END) AS worst FROM x_issues GROUP BY doc_id) i
USING (doc_id)""")

# --- insights -------------------------------------------------------------------------------

_when = {
    "always": "true", "valid": "validation_status = 'valid'",
    "not_valid": "validation_status <> 'valid'",
    "flagged": "validation_status IN ('warning', 'error')",
    "law_not_specified": "contains(lower(governing_law), 'not specified')",
}
_named = ", ".join(text(c) for c in X.FIELDS)


def insight_select(source: str) -> str:
    words = {k: f"coalesce({k}, {text(v)})" for k, v in K.ABSENT.items()}
    words["saving"] = text(K.STATED_SAVING)
    return "\nUNION ALL ".join(
        f"SELECT doc_id, category, {i} AS rank, {text(r.type)} AS type, {text(r.badge)} AS badge, "
        f"{text(r.icon)} AS icon, {fill(r.title, **words)} AS title, "
        f"{fill(r.description, **words)} AS description, {text(r.action)} AS action FROM {source} "
        f"WHERE {_when[r.when]} AND "
        + (f"category = {text(r.category)}" if r.category else f"category NOT IN ({_named})")
        for i, r in enumerate(K.INSIGHTS))


cte("x_insights", f"""SELECT doc_id, category,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS INTEGER) AS insight_ord,
  type, badge, icon, title, description, action FROM ({insight_select('x_checked')})""")

# --- entities and sections ------------------------------------------------------------------

def matches(rule: P.Entity) -> str:
    """Boundaries are ASCII here. Texts beyond ASCII get boundaries written out as classes, which
    take up a character each."""
    flag = "(?i)" if rule.ignore_case else ""
    plain = f"regexp_extract_all(text, {re2(rule.pattern, rule.ignore_case)}, 0)"
    if not rule.whole_words:
        return plain
    inner = spell(rule.pattern.removeprefix(r"\b").removesuffix(r"\b"))
    inner = inner.replace("([A-Z0-9]", "(?:[A-Z0-9]")
    edge = r"[^\p{L}\p{N}_]"
    wide_form = text(rf"{flag}(?:^|{edge})({inner})(?:$|{edge})")
    return (rf"CASE WHEN regexp_matches(text, '^[\x00-\x7f]*$') THEN {plain} "
            f"ELSE regexp_extract_all(text, {wide_form}, 1) END")


def marked(rule: P.Entity) -> str:
    """The text with a mark before and after each match."""
    flag, mark = "(?i)" if rule.ignore_case else "", chr(0xFDD0)
    plain = f"regexp_replace(text, {re2(rule.pattern, rule.ignore_case)}, {text(mark + chr(92) + '0' + mark)}, 'g')"
    if not rule.whole_words:
        return plain
    inner = spell(rule.pattern.removeprefix(r"\b").removesuffix(r"\b"))
    inner = inner.replace("([A-Z0-9]", "(?:[A-Z0-9]")
    edge = r"[^\p{L}\p{N}_]"
    wide_form = text(rf"{flag}(^|{edge})({inner})($|{edge})")
    places = text(chr(92) + f"1{mark}" + chr(92) + f"2{mark}" + chr(92) + "3")
    return (rf"CASE WHEN regexp_matches(text, '^[\x00-\x7f]*$') THEN {plain} "
            f"ELSE regexp_replace(text, {wide_form}, {places}, 'g') END")


for _i, _rule in enumerate(P.ENTITIES):
    cte(f"x_hits_{_i}", f"""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS match_ord, value FROM (
  SELECT doc_id, unnest(hits) AS value, generate_subscripts(hits, 1) AS pos
  FROM (SELECT doc_id, {matches(_rule)} AS hits FROM x_docs))""")
cte("x_hits", "\nUNION ALL ".join(
    f"SELECT doc_id, {i} AS type_ord, {text(r.type)} AS type, match_ord, value FROM x_hits_{i}"
    for i, r in enumerate(P.ENTITIES)))
cte("x_distinct", """SELECT doc_id, type, value, min(type_ord) AS type_ord,
  min(match_ord) AS first_ord, count(*) AS times FROM x_hits GROUP BY doc_id, type, value""")
cte("x_every_entity", """SELECT doc_id,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY type_ord, first_ord) - 1 AS INTEGER)
    AS entity_ord, type, value FROM x_distinct""")
cte("x_entities", f"SELECT * FROM x_every_entity WHERE entity_ord < {P.MAX_ENTITIES}")
cte("x_lines", f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER)
  AS line_no, line FROM (SELECT doc_id, pos, {strip('line')} AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM x_docs)) WHERE line <> ''""")
cte("x_marked", f"""SELECT *, length(line) < {P.HEADING_LENGTH} AND (regexp_matches(line, {re2(P.HEADINGS[0])})
  OR regexp_matches(line, {re2(P.HEADINGS[1])})) AS is_heading FROM x_lines""")

def section_rows(lines: int | None = None) -> str:
    kept = "NOT is_heading" if lines is None else f"NOT is_heading AND nth <= {lines}"
    return f"""SELECT doc_id,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) AS section_ord,
  title, content FROM (
    SELECT doc_id, island,
      coalesce(max(line) FILTER (WHERE is_heading), {text(P.FIRST_SECTION)}) AS title,
      string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE {kept}) AS content
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island, is_heading ORDER BY line_no) AS nth
      FROM (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS island
        FROM x_marked))
    GROUP BY doc_id, island HAVING count(*) FILTER (WHERE NOT is_heading) > 0)"""


cte("x_sections", f"SELECT * FROM ({section_rows(P.MAX_SECTION_LINES)}) WHERE section_ord < {P.MAX_SECTIONS}")

# --- one statement per query ----------------------------------------------------------------

_turn_pages = "SELECT conv_id AS doc_id, turn + 1 AS page_number, text FROM conversations"
_joined_pages = (
    "string_agg(chr(10) || '--- Page ' || page_number || ' ---' || chr(10) || coalesce(text, ''), "
    "'' ORDER BY page_number)")
oracle("scan_text", """SELECT doc_id,
  regexp_replace(text, '\r\n?', chr(10), 'g') || chr(10) AS text FROM documents""")
oracle("scan_pages", """SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, text,
  1 AS tables, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM conversations""")
oracle("assemble_pages", f"""SELECT doc_id, count(*) AS page_count,
  {strip(_joined_pages)} AS text FROM ({_turn_pages}) GROUP BY doc_id""")
oracle("split_pages", f"""SELECT doc_id, CAST(page_number AS INTEGER) AS page_number,
  CASE WHEN page_number = max(page_number) OVER (PARTITION BY doc_id)
    THEN rtrim(text, {text(WHITESPACE)}) ELSE text END AS text FROM ({_turn_pages})""")
oracle("page_count", """SELECT d.doc_id, coalesce(p.n, 1) AS page_count FROM documents d
LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) p
ON p.conv_id = d.doc_id""")
oracle("ingest_filter", f"""SELECT doc_id, original_name, {_extension} AS extension,
  {_extension} IN {_allowed} AS accepted FROM x_raw""")
oracle("empty_text_fill", "SELECT doc_id, text FROM x_docs")
oracle("upsert_latest", """SELECT user_id AS doc_id, event_type, value, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")

# The invoices alone: the same statements over a corpus of one kind.
_edits = f"""SELECT o_orderkey * 8 AS doc_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'grand_total' ELSE 'cost_center' END AS key,
  CASE WHEN o_orderpriority = '1-URGENT' THEN {money('o_totalprice')} ELSE '4812' END AS new_value
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""


def of_kind(name: str) -> str:
    return f"doc_id % 8 = {list(KIND_TABLES).index(name)}"


oracle("apply_edits", f"""SELECT f.doc_id, f.field_ord, f.key, coalesce(e.new_value, f.value) AS value,
  f.label FROM x_fields f LEFT JOIN ({_edits}) e ON e.doc_id = f.doc_id AND e.key = f.key""")
_left = "NOT IN (SELECT doc_id FROM x_checked WHERE validation_status = 'error')"
oracle("cascade_delete", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows_left, CAST(sum(doc_id) AS BIGINT) AS id_sum "
    f"FROM ({source}) WHERE doc_id {_left}"
    for name, source in (
        ("documents", "SELECT doc_id FROM x_checked"),
        ("intelligence", "SELECT doc_id FROM x_issues"),
        ("chat_messages", "SELECT conv_id * 8 AS doc_id FROM conversations"),
    )))
_pairs = """SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""
oracle("chat_pairs", _pairs)
oracle("chat_append", f"""SELECT conv_id, turn, 0 AS turn_ord, 'user' AS role, question AS message,
  '[]' AS citations FROM ({_pairs})
UNION ALL SELECT conv_id, turn, 1, 'assistant', answer, '[]' FROM ({_pairs})""")
oracle("export_fields", """SELECT doc_id, field_ord, label AS "Field Name",
  value AS "Extracted Value", CAST(trunc(confidence * 100) AS INTEGER) || '%' AS "AI Confidence",
  CAST(page AS BIGINT) AS "Document Page" FROM x_fields""")
_defaults = ", ".join(
    f"({i}, " + ", ".join(text(cell) for cell in item) + ")"
    for i, item in enumerate(X.DEFAULT_LINE_ITEMS))
cte("x_all_items", f"""SELECT i.doc_id, i.page_number, i.table_ord, i.item_ord, description, quantity,
  unit_price, total FROM x_items i JOIN x_class c USING (doc_id) WHERE c.category = {text(C.INVOICE)}
UNION ALL SELECT c.doc_id, 1, 0, v.item_ord, v.description, v.quantity, v.unit_price, v.total
FROM x_class c, (VALUES {_defaults}) v(item_ord, description, quantity, unit_price, total)
WHERE c.category = {text(C.INVOICE)}
  AND c.doc_id NOT IN (SELECT doc_id FROM x_items)""")
oracle("line_items", "SELECT * FROM x_all_items")
oracle("export_items", """SELECT doc_id, description AS "Description", quantity AS "Quantity",
  unit_price AS "Unit Price", total AS "Total" FROM x_all_items""")
cte("x_counts_of_insights", "SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM x_insights GROUP BY doc_id")
oracle("export_json_read", """SELECT c.doc_id, c.doc_id AS document_id, c.original_name AS filename, c.category, c.validation_status,
  strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS processed_at, CAST(f.n AS INTEGER) AS fields_count, c.grand_total,
  coalesce(i.totals, '') AS item_totals, coalesce(s.codes, '') AS codes, coalesce(k.n, 0) AS insights_count
FROM x_checked c JOIN (SELECT doc_id, count(*) AS n FROM x_fields GROUP BY doc_id) f USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(total, '|' ORDER BY page_number, table_ord, item_ord, description, quantity, unit_price, total) AS totals FROM x_all_items GROUP BY doc_id) i USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(code, '|' ORDER BY issue_ord) AS codes FROM x_issues GROUP BY doc_id) s USING (doc_id)
LEFT JOIN x_counts_of_insights k USING (doc_id)""")
oracle("export_csv", """SELECT 'fields' AS part, doc_id, 0 AS page_number, 0 AS table_ord, field_ord AS ord, label AS a, value AS b,
  CAST(trunc(confidence * 100) AS INTEGER) || '%' AS c FROM x_fields
UNION ALL SELECT 'items', doc_id, page_number, table_ord, item_ord, description, quantity, total FROM x_all_items""")
oracle("json_decode", f"""SELECT f.doc_id, c.issues_count, f.key, f.value, f.confidence, f.label
FROM x_fields f JOIN x_checked c USING (doc_id)""")

_slim = "doc_id, original_name, category, validation_status"
oracle("filter_category", f"SELECT {_slim} FROM x_checked WHERE category = 'Legal Contract'")
oracle("filter_status", f"SELECT {_slim} FROM x_checked WHERE validation_status = 'error'")
oracle("search_docs", f"""SELECT {_slim} FROM x_checked
WHERE contains(lower(original_name), 'bill') OR contains(lower(category), 'bill')""")
oracle("search_docs_wide", f"""SELECT {_slim} FROM x_checked
WHERE lower(original_name || chr(0) || category || chr(0) || validation_status) LIKE '%warning%'""")
oracle("status_bucket", f"""SELECT {_slim} FROM x_checked
WHERE validation_status IN ('warning', 'needs_review')""")
oracle("filter_user", f"SELECT {_slim} FROM x_checked WHERE user_id = 3")
cte("x_counts", """SELECT c.doc_id, c.category, c.validation_status, c.issues_count,
  CAST(f.n AS INTEGER) AS fields_count FROM x_checked c
JOIN (SELECT doc_id, count(*) AS n FROM x_fields GROUP BY doc_id) f USING (doc_id)""")
_with_intel = """SELECT r.doc_id, r.original_name, c.category, c.validation_status,
  coalesce(c.fields_count, 0) AS fields_count, coalesce(c.issues_count, 0) AS issues_count
FROM x_raw r LEFT JOIN x_counts c USING (doc_id)"""
oracle("docs_left_intel", _with_intel)
oracle("doc_by_id", _with_intel + f" WHERE r.doc_id = {56 * 8}")
_requests = ("SELECT o_orderkey * 8 AS doc_id FROM orders "
             f"UNION ALL SELECT n_nationkey * 8 + {S.KINDS.index('reject')} FROM nation")
oracle("known_docs", f"SELECT doc_id FROM ({_requests}) WHERE doc_id IN (SELECT doc_id FROM x_docs)")
oracle("unknown_docs",
       f"SELECT doc_id FROM ({_requests}) WHERE doc_id NOT IN (SELECT doc_id FROM x_docs)")

_mean = ("coalesce(nullif(CAST(sum(CAST(category_confidence AS DECIMAL(10, 4))) AS DOUBLE) "
         "/ count(*), 0), 0.95::DOUBLE) * 100")
oracle("dashboard_kpis", f"""SELECT count(*) AS total_documents,
  count(*) FILTER (WHERE validation_status = 'valid') AS valid_documents,
  count(*) FILTER (WHERE validation_status IN ('warning', 'needs_review')) AS needs_review,
  count(*) FILTER (WHERE validation_status = 'error') AS high_risk_errors,
  {exact(_mean, 1)} AS average_confidence FROM x_checked""")
_by_category = "SELECT category, count(*) AS documents FROM x_class GROUP BY category"
oracle("category_counts", _by_category)
oracle("category_share", f"""SELECT category, documents,
  CAST(floor(documents / (SELECT count(*) FROM x_class) * 100 + 0.5) AS BIGINT) AS percent
FROM ({_by_category})""")
oracle("total_anomalies", "SELECT count(*) AS total_anomalies FROM x_issues")
cte("x_vendors", """SELECT name, count(*) AS frequency, max(created_at) AS newest,
  arg_max(doc_id, (created_at, doc_id)) AS newest_id FROM (
    SELECT w.doc_id, c.created_at, coalesce(nullif(w.vendor_name, ''), nullif(w.party_two, '')) AS name
    FROM x_wide w JOIN x_class c USING (doc_id))
WHERE name IS NOT NULL AND name NOT IN ('N/A', 'None') GROUP BY name""")
oracle("vendor_frequency", "SELECT name, frequency FROM x_vendors")
oracle("top_vendors", """SELECT name, frequency FROM x_vendors
ORDER BY frequency DESC, newest DESC, newest_id DESC LIMIT 6""")
oracle("urgent_risks", """SELECT i.doc_id, c.original_name AS doc_title, i.title AS issue, i.message
FROM x_issues i JOIN x_class c USING (doc_id) WHERE i.severity = 'error'
ORDER BY c.created_at DESC, i.doc_id DESC, i.issue_ord LIMIT 5""")
_deadlines = """SELECT f.doc_id, c.original_name AS doc_title, f.label, f.value AS date
FROM x_fields f JOIN x_class c USING (doc_id)
WHERE f.key IN ('due_date', 'expiration_date', 'corrective_deadline', 'expiry_date')"""
oracle("deadlines", _deadlines + " ORDER BY c.created_at DESC, f.doc_id DESC, f.field_ord LIMIT 6")
oracle("deadlines_by_date", _deadlines + f""" ORDER BY {parse_date('f.value')} NULLS LAST,
c.created_at DESC, f.doc_id DESC, f.field_ord LIMIT 6""")
_stamp = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
oracle("docs_recent", f"SELECT doc_id, original_name, {_stamp} AS created_at FROM x_docs")
oracle("recent_docs", f"""SELECT doc_id, original_name AS title, category, validation_status AS status,
  CAST(trunc(category_confidence * 100) AS INTEGER) AS confidence, {_stamp} AS timestamp
FROM x_checked ORDER BY x_checked.created_at DESC, doc_id DESC LIMIT 6""")
oracle("chat_history", """SELECT user_id AS doc_id, event_id AS message_id, event_type AS message,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events""")
oracle("line_sum", "SELECT doc_id, line_count, line_sum FROM x_line_totals")
oracle("doc_counts", "SELECT doc_id, fields_count, issues_count FROM x_counts")

oracle("keyword_scores", "SELECT doc_id, category, kw AS points FROM x_points")
oracle("pattern_scores", "SELECT doc_id, category, pat AS points FROM x_points")
oracle("category_scores", "SELECT doc_id, category, ord, score FROM x_scores")
oracle("classify_docs", "SELECT doc_id, category, category_confidence, best_score FROM x_class")
oracle("classify_fallback", f"""SELECT doc_id, original_name, category, category_confidence,
  best_score < 10 AS weak FROM x_class""")

for _name, _category in SLUGS.items():
    _own = f"category = {text(_category)}" if _category else f"category NOT IN ({_named})"
    oracle(f"fields_{_name}", f"""SELECT doc_id, category, field_ord, key, value, is_default
FROM x_fields WHERE {_own}""")
    oracle(f"insights_{_name}", f"SELECT * FROM x_insights WHERE {_own}")
oracle("fields_long", """SELECT doc_id, category, field_ord, key, value, confidence, page, label,
  is_default FROM x_fields""")
oracle("extraction_coverage", """SELECT category, key, count(*) AS documents,
  count(*) FILTER (WHERE is_default) AS defaulted,
  count(*) FILTER (WHERE is_default) / count(*) AS default_share
FROM x_fields_null GROUP BY category, key""")

for _i, _name in enumerate(("money", "date", "id", "email")):
    oracle(f"entities_{_name}", f"SELECT doc_id, match_ord, value FROM x_hits_{_i}")
oracle("entities", "SELECT doc_id, entity_ord, type, value FROM x_entities")
oracle("entities_all", "SELECT doc_id, entity_ord, type, value FROM x_every_entity")
def span_rows(docs: str) -> str:
    """First occurrences of every entity with their spans."""
    return "\nUNION ALL ".join(
        f"""SELECT doc_id, {text(r.type)} AS type, value, min(start) AS span_start, min(start) + CAST(length(value) AS INTEGER) AS span_end
FROM (SELECT doc_id, parts[2 * j] AS value, CAST(length(array_to_string(parts[1:2 * j - 1], '')) AS INTEGER) AS start
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts) // 2)) AS j
    FROM (SELECT doc_id, string_split({marked(r)}, chr({0xFDD0})) AS parts FROM {docs})))
GROUP BY doc_id, value""" for r in P.ENTITIES)


oracle("entity_spans", f"SELECT *, value AS covered FROM ({span_rows('x_docs')})")
cte("x_turn_docs", f"SELECT doc_id, {strip(_joined_pages)} AS text FROM ({_turn_pages}) GROUP BY doc_id")
cte("x_turn_starts", f"""SELECT doc_id, page_number, sum(marker + size) OVER (PARTITION BY doc_id ORDER BY page_number) - size - 1 AS start
FROM (SELECT doc_id, page_number, length('--- Page ' || page_number || ' ---') + 2 AS marker, length(coalesce(text, '')) AS size FROM ({_turn_pages}))""")
oracle("entity_pages", f"""SELECT e.doc_id, e.type, e.value, e.span_start, e.span_end, CAST(max(s.page_number) AS INTEGER) AS page_number
FROM ({span_rows('x_turn_docs')}) e LEFT JOIN x_turn_starts s ON s.doc_id = e.doc_id AND s.start <= e.span_start GROUP BY ALL""")
oracle("entities_distinct", "SELECT doc_id, type, value, first_ord, times FROM x_distinct")
oracle("entity_totals",
       "SELECT type, value, count(*) AS documents FROM x_distinct GROUP BY type, value")
oracle("doc_lines", "SELECT doc_id, line_no, line FROM x_lines")
oracle("section_headers", "SELECT doc_id, line_no, line FROM x_marked WHERE is_heading")
oracle("sections", "SELECT doc_id, section_ord, title, content FROM x_sections")
oracle("sections_all", section_rows())

_cells = """SELECT unnest(CASE WHEN short THEN
    CASE WHEN page_number = 7 THEN [description] ELSE [description, quantity] END
  ELSE [description, quantity, unit_price, total] END) AS cell FROM x_cells"""
oracle("parse_num_cells", f"""SELECT cell, count(*) AS n, {parse_num('cell')} AS number
FROM ({_cells} UNION ALL SELECT url FROM pages) GROUP BY cell""")
oracle("parse_date_cells", f"""SELECT cell, count(*) AS n, {iso(parse_date('cell'))} AS day
FROM (SELECT ' ' || {spelled_date('o_orderdate', 'o_orderkey')} AS cell FROM orders
UNION ALL SELECT url FROM pages) GROUP BY cell""")

oracle("issue_messages", "SELECT * FROM x_issues")
oracle("validate_docs", """SELECT doc_id, category, issues_count, validation_score, validation_status,
  validation_status = 'valid' AS is_approved FROM x_checked""")
oracle("validation_score", "SELECT doc_id, validation_score FROM x_checked")
oracle("validation_status", """SELECT category, validation_status, count(*) AS documents
FROM x_checked GROUP BY category, validation_status""")
for _rule in A.CATEGORY_ISSUES:
    oracle(f"rule_{_rule.code.lower()}", f"SELECT * FROM x_issues WHERE code = '{_rule.code}'")
cte("x_wide_null", wide("x_fields_null"))
cte("x_read_null", readings("x_wide_null")
    .replace(f"coalesce(t.line_count, {len(X.DEFAULT_LINE_ITEMS)})", "coalesce(t.line_count, 0)")
    .replace(f"coalesce(t.line_sum, {_default_sum}::DOUBLE)", "t.line_sum"))
_null_issues = ranked_issues(
    category_issues("x_read_null") + "\nUNION ALL " + field_issues("x_fields_null"))
oracle("rule_missing_field", f"SELECT * FROM ({_null_issues}) WHERE code = 'MISSING_FIELD'")
_lowered = "CAST(CAST(confidence AS DECIMAL(4, 2)) - 0.1 AS DOUBLE)"
_low_issues = ranked_issues(
    category_issues("x_read") + "\nUNION ALL " + field_issues("x_fields", _lowered))
oracle("rule_low_confidence",
       f"SELECT * FROM ({_low_issues}) WHERE code = 'LOW_CONFIDENCE'")

_intents = " ".join(
    f"WHEN {any_of('lower(text)', words)} THEN {text(intent)}" for intent, words in Q.TRIGGERS.items())
oracle("question_intent", f"""SELECT conv_id, turn, CASE {_intents} ELSE 'search' END AS intent
FROM conversations WHERE role = 'user'""")


def search_words(question: str) -> list[str]:
    return [w for w in re.findall(r"\w+", question.lower())
            if len(w) > Q.MIN_WORD and w not in Q.STOP_WORDS]


def snippet_rows(condition: str, cap: str = f"WHERE snippet_ord < {Q.MAX_SNIPPETS}") -> str:
    """Every line, blank or not, so that short ones are judged by the rule itself."""
    return f"""SELECT * FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1
  AS INTEGER) AS snippet_ord, line AS snippet FROM (
    SELECT doc_id, line, min(line_no) AS pos FROM x_lines
    WHERE length(line) > {Q.MIN_LINE} AND {condition} GROUP BY doc_id, line))
{cap}"""


oracle("snippet_search", snippet_rows(any_of("lower(line)", search_words(QUESTION))))
oracle("snippets_all", snippet_rows(any_of("lower(line)", search_words(QUESTION)), ""))

cte("x_section_counts", "SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM x_sections GROUP BY doc_id")
cte("x_entity_counts", "SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM x_entities GROUP BY doc_id")
cte("x_insight_counts", "SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM x_insights GROUP BY doc_id")


def counted(extra: str = "", where: str = "true") -> str:
    return f"""SELECT c.doc_id, c.category, c.category_confidence, c.validation_status, {extra}
  f.fields_count, coalesce(s.n, 0) AS sections_count, coalesce(e.n, 0) AS entities_count,
  c.issues_count, coalesce(i.n, 0) AS insights_count
FROM x_checked c JOIN x_counts f USING (doc_id) LEFT JOIN x_section_counts s USING (doc_id)
LEFT JOIN x_entity_counts e USING (doc_id) LEFT JOIN x_insight_counts i USING (doc_id)
WHERE {where}"""


oracle("process_batch", counted("c.validation_score,"))
oracle("process_stream", counted("c.validation_score,", of_kind("free_texts")))
oracle("process_incremental", counted(
    "c.validation_score,", "doc_id NOT IN (SELECT doc_id * 8 + 5 FROM labels)"))
_counted = ("category", "category_confidence", "validation_status", "validation_score", "fields_count",
            "sections_count", "entities_count", "issues_count", "insights_count")
oracle("reprocess", f"""SELECT doc_id, CASE WHEN again THEN 'reprocessed' ELSE 'stored' END AS state,
  {', '.join(f'CASE WHEN again THEN {c} END AS {c}' for c in _counted)}
FROM (SELECT *, doc_id IN (SELECT doc_id * 8 + 5 FROM labels) AS again
  FROM ({counted("c.validation_score,")}))""")

# Edited invoices: the wide row with another total, then the same rules again.
cte("x_edits", _edits)
cte("x_wide_edited", """SELECT w.* REPLACE (CASE WHEN e.key = 'grand_total' THEN e.new_value
  ELSE w.grand_total END AS grand_total) FROM x_wide w JOIN x_edits e USING (doc_id)""")
cte("x_read_edited", readings("x_wide_edited"))
cte("x_issues_edited", category_issues("x_read_edited"))
_recomputed = f"""SELECT doc_id, CAST(greatest(0, 100 - lost) AS INTEGER) AS validation_score,
  CASE worst WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'valid' END AS validation_status,
  CAST(n AS INTEGER) AS issues_count,
  CASE WHEN category = {text(C.INVOICE)} THEN 3 ELSE 1 END AS insights_count
FROM (SELECT r.doc_id, any_value(r.category) AS category, count(i.code) AS n, coalesce(sum(i.penalty), 0) AS lost,
    max(CASE i.severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst
  FROM x_read_edited r LEFT JOIN x_issues_edited i USING (doc_id) GROUP BY r.doc_id)"""
oracle("recompute", _recomputed)

cte("x_recomputed", _recomputed)
cte("x_stored", """SELECT c.doc_id, CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN 'again-' ELSE '' END || c.original_name AS original_name,
  c.category, c.category_confidence, coalesce(e.validation_status, c.validation_status) AS validation_status,
  coalesce(e.validation_score, c.validation_score) AS validation_score, coalesce(e.issues_count, c.issues_count) AS issues_count,
  coalesce(nullif(w.vendor_name, ''), nullif(w.party_two, '')) AS counterparty
FROM x_checked c JOIN x_wide w ON w.doc_id = c.doc_id LEFT JOIN orders o ON c.doc_id = o.o_orderkey * 8 LEFT JOIN x_recomputed e ON e.doc_id = c.doc_id
WHERE coalesce(e.validation_status, c.validation_status) <> 'error'""")
oracle("store_merge", "SELECT doc_id, original_name, category, validation_status, validation_score, issues_count FROM x_stored")
oracle("dashboard_incremental", """SELECT kind, name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM (
  SELECT 'documents' AS kind, '' AS name, 1 AS n, CAST(0 AS DECIMAL(10, 4)) AS amount FROM x_stored
  UNION ALL SELECT 'confidence', '', 1, CAST(category_confidence AS DECIMAL(10, 4)) FROM x_stored WHERE category_confidence IS NOT NULL
  UNION ALL SELECT 'status', validation_status, 1, 0 FROM x_stored
  UNION ALL SELECT 'category', category, 1, 0 FROM x_stored
  UNION ALL SELECT 'anomalies', '', issues_count, 0 FROM x_stored
  UNION ALL SELECT 'counterparty', counterparty, 1, 0 FROM x_stored WHERE counterparty NOT IN ('N/A', 'None')
) GROUP BY kind, name""")
oracle("stream_upsert", counted("c.validation_score,"))
oracle("store_lookup", _with_intel + f" WHERE r.doc_id = {56 * 8}")
oracle("append_documents", """SELECT 'uploads' AS category, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/pdf' END AS mime_type,
  count(*) AS documents, CAST(sum(length(html)) AS BIGINT) AS file_size, count(DISTINCT url) AS ids FROM pages GROUP BY ALL""")

# Answers: the parts of every answer as aggregates over the long tables, put together by intent.
_question = pick("doc_id // 8 + doc_id", ASKED)
_wanted = {i: any_of("lower(question)", words) for i, words in Q.TRIGGERS.items()}
_is_date = any_of("key", Q.DATE_KEY_PARTS)
_party_rank = "list_position([" + ", ".join(text(k) for k in Q.PARTY_KEYS) + "], key)"
_percent = "CAST(trunc({} * 100) AS INTEGER)"
_field = {"label": "label", "value": "value", "percent": _percent.format("confidence")}
_cited = "label || '|Page ' || page || '|' || key"


def cited(citation: tuple[str, str, str]) -> str:
    return text("|".join(citation))


cte("x_field_parts", f"""SELECT doc_id,
  string_agg({fill(Q.DATE_LINE, **_field)}, chr(10) ORDER BY field_ord) FILTER (WHERE {_is_date}) AS date_lines,
  string_agg({_cited}, chr(10) ORDER BY field_ord) FILTER (WHERE {_is_date}) AS date_cites,
  string_agg({fill(Q.PARTY_LINE, **_field)}, chr(10) ORDER BY {_party_rank}) FILTER (WHERE {_party_rank} > 0) AS party_lines,
  string_agg({_cited}, chr(10) ORDER BY {_party_rank}) FILTER (WHERE {_party_rank} > 0) AS party_cites,
  string_agg({fill(Q.SUMMARY_FIELD, **_field)}, '' ORDER BY field_ord) FILTER (WHERE field_ord < {Q.SUMMARY_FIELDS}) AS summary_fields,
  count(*) AS n FROM x_fields GROUP BY doc_id""")
_issue = {"title": "title", "message": "message", "icon":
          f"CASE severity WHEN 'error' THEN {text(Q.ERROR_ICON)} ELSE {text(Q.OTHER_ICON)} END"}
cte("x_issue_parts", f"""SELECT doc_id, count(*) AS n,
  string_agg({fill(Q.RISK_LINE, **_issue)}, chr(10) || chr(10) ORDER BY issue_ord) AS risk_lines,
  string_agg(field || '|Audit Log|' || code, chr(10) ORDER BY issue_ord) AS risk_cites,
  arg_min(message, issue_ord) FILTER (WHERE {any_of("lower(code)", Q.ARITHMETIC_CODES)}) AS alert
FROM x_issues GROUP BY doc_id""")
_insight = {k: k for k in ("badge", "title", "description")}
cte("x_insight_parts", f"""SELECT doc_id, string_agg({fill(Q.SUMMARY_INSIGHT, **_insight)}, ''
  ORDER BY insight_ord) FILTER (WHERE insight_ord < {Q.SUMMARY_INSIGHTS}) AS lines
FROM x_insights GROUP BY doc_id""")
cte("x_asked", f"SELECT doc_id, {_question} AS question FROM x_docs")
for _suffix, _cap in (("", f"WHERE snippet_ord < {Q.MAX_SNIPPETS}"), ("_all", "")):
    cte(f"x_snippets{_suffix}", "\nUNION ALL ".join(
    f"SELECT a.doc_id, string_agg({fill(Q.SNIPPET_LINE, line='s.snippet')}, chr(10) "
    f"ORDER BY s.snippet_ord) AS lines FROM x_asked a JOIN ("
    f"{snippet_rows(any_of('lower(line)', search_words(q)), _cap)}) s USING (doc_id) "
    f"WHERE a.question = {text(q)} GROUP BY a.doc_id" for q in ASKED if search_words(q)))
    cte(f"x_decided{_suffix}", f"""SELECT a.question, c.*, w.* EXCLUDE (doc_id), i.* EXCLUDE (doc_id, n), i.n AS issue_n,
  k.lines AS insight_lines, s.lines AS snippet_lines, v.payment_terms AS terms,
  CASE WHEN {_wanted['money']} AND category = {text(C.INVOICE)} THEN 'money_invoice'
    WHEN {_wanted['money']} AND category = {text(C.CONTRACT)} THEN 'money_contract'
    WHEN {_wanted['dates']} AND date_lines IS NOT NULL THEN 'dates'
    WHEN {_wanted['risk']} THEN 'risk' WHEN {_wanted['summary']} THEN 'summary'
    WHEN {_wanted['parties']} AND party_lines IS NOT NULL THEN 'parties'
    WHEN s.lines IS NOT NULL THEN 'search' ELSE 'overview' END AS intent
FROM x_asked a JOIN x_checked c USING (doc_id) JOIN x_field_parts w USING (doc_id)
JOIN x_wide v USING (doc_id) LEFT JOIN x_issue_parts i USING (doc_id)
LEFT JOIN x_insight_parts k USING (doc_id) LEFT JOIN x_snippets{_suffix} s USING (doc_id)""")
_alert = fill(Q.MONEY_ALERT, message="alert")
_answers = {
    "money_invoice": (fill(
        Q.MONEY_INVOICE, grand_total="grand_total", subtotal="subtotal", tax_amount="tax_amount",
        payment_terms="terms", alert=f"CASE WHEN alert IS NULL THEN '' ELSE {_alert} END"),
        cited(Q.CITE_TOTAL)),
    "money_contract": (fill(Q.MONEY_CONTRACT, liability_cap="liability_cap"), cited(Q.CITE_CAP)),
    "dates": (fill(Q.DATES, lines="date_lines"), "date_cites"),
    "risk": (
        f"CASE WHEN issue_n IS NULL THEN {fill(Q.NO_RISK, score='validation_score')} ELSE "
        + fill(Q.RISKS, count="issue_n", plural="CASE WHEN issue_n > 1 THEN 's' ELSE '' END",
               lines="risk_lines") + " END",
        f"coalesce(risk_cites, {cited(Q.CITE_HEALTH)})"),
    "summary": (fill(
        Q.SUMMARY, category="category", percent=_percent.format("category_confidence"),
        fields="summary_fields", insights="insight_lines"), cited(Q.CITE_SUMMARY)),
    "parties": (fill(Q.PARTIES, lines="party_lines"), "party_cites"),
    "search": (fill(Q.SNIPPETS, lines="snippet_lines"), cited(Q.CITE_SEARCH)),
    "overview": (fill(
        Q.OVERVIEW, name="original_name", category="category", count="n",
        score="validation_score"), cited(Q.CITE_OVERVIEW)),
}
_cases = [" ".join(f"WHEN '{i}' THEN {parts[j]}" for i, parts in _answers.items()) for j in (0, 1)]
for _name, _suffix in (("answer_batch", ""), ("answer_all", "_all")):
    oracle(_name, f"""SELECT doc_id AS question_id, doc_id, question, intent,
  CASE intent {_cases[0]} END AS answer, CASE intent {_cases[1]} END AS citations FROM x_decided{_suffix}""")

for _name, _plain in (("urgent_risks_recent", "urgent_risks"), ("deadlines_recent", "deadlines"), ("recent_docs_daily", "recent_docs")):
    ORACLES[_name] = ORACLES[_plain]
