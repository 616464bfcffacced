"""Texts with nothing to strip are not walked over."""

from pyspark.sql import functions as F

from ledgerleaf.functions.text import first_line, strip, strip_cheaply
from ledgerleaf.functions.patterns import WHITESPACE
from ledgerleaf.plans import pipeline

TEXTS = ["", " ", "a", " a", "a ", "a\nb", "a\n", "\na", "é", "é ", "\xa0a", "a　", "a \n b", "!", "~", "\x7f", "\x1ca\x1f", "a\x85", "\U0001f600 ", *WHITESPACE]


def test_stripping_is_that_of_python(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    for r in rows.select("t", strip_cheaply(F.col("t")).alias("s"), strip(F.col("t")).alias("w"), first_line(F.col("t")).alias("f")).collect():
        assert r.s == r.w and (r.t is None or r.s == r.t.strip(WHITESPACE))
        assert r.f == (None if r.t is None else r.t.strip(WHITESPACE).split("\n")[0].strip(WHITESPACE))


def test_documents_are_asked_for_their_ends_before_they_are_stripped(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "a b")], "doc_id long, original_name string, text string")
    plan = pipeline.prepare(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "as binary" in plan and plan.index("as binary") < plan.index("trim(")
