"""Words of categories are looked for in batches of texts, not text by text."""

from pyspark.sql import functions as F

from ledgerleaf.functions.words import word_points, words_within
from ledgerleaf.operators import classify
from ledgerleaf.plans import pipeline
from ledgerleaf.registry.queries import QUERIES
from ledgerleaf.rules import categories as C

TEXTS = ["", None, "aaaaa", "aa", "a", "vat\nvat", "va", "t vat", "ſex vat é vat", "private vat vat vat vat vat vat", "in", "voice invoice"]


def test_places_are_counted_within_each_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, text string").repartition(2)
    groups, heads = {"one": ("aa", "vat"), "two": ("invoice",)}, {"vat": 0, "invoice": 5}
    found = {r.i: r for r in rows.select("i", word_points(F.col("text"), groups, 8, 32).alias("p"), words_within(F.col("text"), heads).alias("w")).collect()}
    for i, text in enumerate(t or "" for t in TEXTS):
        assert found[i].p.one == sum(min(8 * text.count(w), 32) for w in groups["one"])
        assert found[i].p.two == min(8 * text.count("invoice"), 32)
        assert found[i].w == ("vat" in text) + 32 * ("invoice" in text)


def test_classification_looks_for_no_word_text_by_text(spark, sf):
    for name in ("fields_long", "extraction_coverage", "export_fields", "json_decode"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan.replace("Aggregate", "") and "Contains(haystack" not in plan and "ArrowEvalPython" in plan


def test_scores_are_those_of_python(spark):
    texts = [" ".join(w for c in C.CATEGORIES for w in c.keywords), "INVOICE inv-123 inv 4567 total   amount", "Section 4 whereas", "", "dob: 12 passport no"]
    docs = pipeline.prepare(spark.createDataFrame([(i, "x.pdf", t) for i, t in enumerate(texts)], "doc_id long, original_name string, text string"))
    hay = {r.doc_id: r.haystack for r in classify.with_haystack(docs).collect()}
    points = {r.doc_id: r.keywords for r in classify.with_haystack(docs).collect()}
    for i, text in hay.items():
        for c in C.CATEGORIES:
            assert points[i][c.slug] == sum(min(C.KEYWORD_POINTS * text.count(w), C.KEYWORD_CEILING) for w in c.keywords)
