"""Reports that read no more days than they need."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import portfolio
from ledgerleaf.plans import daily, pipeline


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Forty days; only some invoices are wrong, and the last days have few."""
    rows = []
    for day in range(40):
        for k in range(2 if day > 35 else 5):
            total = "9,000.00" if (day * 5 + k) % 7 == 0 else "1,100.00"
            rows.append((day * 10 + k, f"{day}-{k}.txt", f"INVOICE\nInvoice Date: 2026-09-02\nDue Date: 2026-12-02\nSubtotal: $1,000.00\nTax: $100.00\nGrand Total: ${total}\n",
                         datetime.datetime(2026, 1, 1, 12) + datetime.timedelta(days=day, minutes=k)))
    rows.append((999, "no time.txt", "INVOICE\nSubtotal: $1,000.00\nTax: $100.00\nGrand Total: $7,000.00\n", None))
    docs = pipeline.process(spark.createDataFrame(rows, "doc_id long, original_name string, text string, created_at timestamp"))
    path = str(tmp_path_factory.mktemp("daily") / "docs")
    daily.store_by_day(docs, path)
    return docs, path


@pytest.mark.parametrize("report,rows", [(portfolio.urgent_risks, 5), (portfolio.deadlines, 6), (portfolio.recent_documents, 6)])
def test_same_rows_from_few_days(spark, stored, report, rows):
    docs, path = stored
    found = daily.newest(spark, path, report, rows)
    assert found.collect() == report(docs).collect()
    leaves = found._jdf.queryExecution().sparkPlan().collectLeaves()
    opened = [leaves.apply(k).selectedPartitions().partitionCount() for k in range(leaves.size())]
    assert opened in ([1], [4], [16])  # of 41
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()


def test_all_days_where_rows_are_few(spark, stored):
    docs, path = stored
    report = lambda rows: portfolio.urgent_risks(rows.where("doc_id % 10 = 0"), 50)
    assert daily.newest(spark, path, report, 50).collect() == report(docs).collect()
    late = lambda rows: portfolio.urgent_risks(rows.where("doc_id = 999"))
    assert [r.doc_id for r in daily.newest(spark, path, late, 5).collect()] == [999] * late(docs).count()
    assert daily.days(spark, path)[0] == "2026-02-09" and daily.days(spark, path)[-1] is None and len(daily.days(spark, path)) == 41


def test_more_days_later(spark, stored, tmp_path):
    docs, _ = stored
    path = str(tmp_path / "two")
    daily.store_by_day(docs.where("doc_id < 100"), path)
    daily.store_by_day(docs.where("doc_id >= 100"), path)
    assert daily.newest(spark, path, portfolio.recent_documents, 6).collect() == portfolio.recent_documents(docs).collect()
    assert daily.of_days(spark, path, []).count() == 0 and daily.of_days(spark, path, [None]).select(F.min("doc_id")).first()[0] == 999
