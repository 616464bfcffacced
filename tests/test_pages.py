"""Page starts and the pages of spans."""

import random

from pyspark.sql import functions as F

from ledgerleaf.functions.offsets import last_upto, with_running_sums
from ledgerleaf.operators import passages
from ledgerleaf.sources import pages


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(0, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 3, 4, 5, 16, 17, 99, 1000))]
    got = with_running_sums(spark.createDataFrame(rows, "id int, lengths array<int>"), "lengths", "sums").collect()
    assert got[0].asDict().keys() == {"id", "lengths", "sums"}
    for r in got:
        assert r.sums == [sum(r.lengths[:k + 1]) for k in range(len(r.lengths))]


def test_last_upto(spark):
    rows = [(starts, at) for starts in ([], [3], [0, 5, 5, 9], list(range(0, 3000, 3))) for at in (-1, 0, 2, 3, 5, 8, 9, 10, 2997, 5000)]
    got = spark.createDataFrame(rows, "starts array<int>, at int").select("starts", "at", last_upto(F.col("starts"), F.col("at")).alias("k")).collect()
    for r in got:
        assert r.k == sum(s <= r.at for s in r.starts) - 1


def test_entities_on_their_pages(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(5):
        for page in range(1, rng.choice((1, 2, 40, 300)) + 1):
            rows.append((doc, page, None if page % 17 == 3 else f"é page of {doc}: $ {page}.50 and m{doc}.{page}@example.com\n" + "x " * rng.randrange(30)))
    table = spark.createDataFrame(rows, "doc_id long, page_number int, text string")
    docs = pages.with_page_starts(pages.assemble(table).select("doc_id", "text"))
    found = passages.extract_entities(docs, caps=None).select("doc_id", F.inline(F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), pages.page_at(e["span"][0]).alias("page")))))
    mails = [r for r in found.collect() if r.type == "EMAIL"]
    assert len(mails) == sum(t is not None for *_, t in rows)
    assert all(r.value == f"m{r.doc_id}.{r.page}@example.com" for r in mails)
