"""Documents stored by day, and reports that go back only as far as they need.

A report in recency order is certain once it has all its rows: whatever lies in older days comes after them. So the
newest day is read first, then four times as many days, and so on; older folders are never opened. Days are found
from the names of the folders.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

DAY = "day"
#: How many times as many days are read when those read do not suffice.
FURTHER = 4


def store_by_day(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Write documents into a folder for each day of `created_at`; those without a time have one of their own. Tasks
    hold ranges of time and id, so a busy day is dealt out to several of them and quiet days share one."""
    rows = docs.withColumn(DAY, F.to_date("created_at"))
    rows.repartitionByRange("created_at", "doc_id").sortWithinPartitions(DAY, F.desc("created_at")).write.mode(mode).partitionBy(DAY).parquet(path)


def days(spark: SparkSession, path: str) -> list[str | None]:
    """The days that are there, newest first, then that of documents without a time."""
    found = {re.search(rf"/{DAY}=([^/]+)/", name).group(1) for name in spark.read.parquet(path).inputFiles()}
    known = sorted((d for d in found if d[0].isdigit()), reverse=True)
    return [*known, None] if len(known) < len(found) else known


def of_days(spark: SparkSession, path: str, some: list[str | None]) -> DataFrame:
    rows = spark.read.parquet(path)
    there = F.col(DAY).isin([d for d in some if d]) if any(some) else F.lit(False)
    return rows.where(there | F.col(DAY).isNull() if None in some else there).drop(DAY)


def newest(spark: SparkSession, path: str, report: Callable[[DataFrame], DataFrame], rows: int) -> DataFrame:
    """The first rows of a report that lists documents newest first and gives at most `rows`."""
    known, taken = days(spark, path), 1
    while True:
        shown = report(of_days(spark, path, known[:taken]))
        if taken >= len(known) or shown.count() >= rows:
            return shown
        taken *= FURTHER
