"""Boundary rows of the scalar readings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import values as V


def read(spark, cells, function):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("cell"))).collect()]


def test_parse_num(spark):
    cells = ["$1,234.50", "-5", "1.2.3", "", None, ".", "5.", "74.5%"]
    assert read(spark, cells, V.parse_num) == [1234.5, 5.0, 0.0, 0.0, 0.0, 0.0, 5.0, 74.5]


@pytest.mark.parametrize("text, day", [
    ("2024-1-5", (2024, 1, 5)), (" 2024-01-05\n", (2024, 1, 5)), ("31/02/2024", None),
    ("05/08/2024", (2024, 8, 5)), ("12/25/2026", (2026, 12, 25)), ("25-12-2026", (2026, 12, 25)),
    ("January 5, 2024", (2024, 1, 5)), ("Jan 5 2024", (2024, 1, 5)), ("may 31, 2024", (2024, 5, 31)),
    ("Sept 5, 2024", None), ("2024/01/05", None), ("05/08/24", None), ("0000-01-01", None),
    ("2024-001-05", None), ("January 5,2024", None), ("", None), (None, None),
    ("2024-01- 5", (2024, 1, 5)),
])
def test_parse_date(spark, text, day):
    assert read(spark, [text], V.parse_date) == [dt.date(*day) if day else None]


def test_rounding_is_pythons(spark):
    numbers = [0.865, 0.915, 0.975, 2.675, 1.005, 0.125, 13.0, 1e6 + 0.005]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = rows.orderBy("i").select(V.round_exact(F.col("x")), V.money(F.col("x"))).collect()
    assert [r[0] for r in got] == [round(x, 2) for x in numbers]
    assert [r[1] for r in got] == [f"{x:,.2f}" for x in numbers]


def test_percent_cuts_off(spark):
    rows = spark.createDataFrame([(0.29,), (0.57,), (0.98,)], "x double")
    assert [r[0] for r in rows.select(V.percent(F.col("x"))).collect()] == [
        int(x * 100) for x in (0.29, 0.57, 0.98)]
