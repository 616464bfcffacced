"""Approximation files against all scores."""

import numpy as np
from pyspark.sql import functions as F

from ledgerleaf.llm import va_search

SCHEMA = "vec_id long, embedding array<float>, score string, label int"


def brute(rows, k, scale=64):
    good = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v, *_ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, point in good:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(point, v)), i) for i, v in good if i != q and len(v) == len(point))
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "s", i) for i in range(700)]
    rows += [(i + 700, rows[i % 7][1], None, None) for i in range(60)]  # ties
    rows += [(2000, None, "", 1), (2020, [], "", 1), (2040, [None] * 8, "", 1), (2060, [float("nan")] * 8, "", 1), (None, rows[0][1], "", 1)]
    rows += [(3000, [1.0, 2.0], "", 1), (3001, [1.0, -2.0], "", 1)]
    monkeypatch.setattr(va_search, "VECTORS", 200)
    monkeypatch.setattr(va_search, "QUERIES", 16)
    got = va_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=20)
    got_rows = [tuple(r) for r in got.collect()]
    assert len(got_rows) == len(set(got_rows)) and set(got_rows) == brute(rows, 20)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert va_search.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components(spark):
    import math

    given = [(i, [x, 0.25 * i, -1.0]) for i, x in enumerate([0.5, 4e7, -4e7, 1e9 + 3, 1e12, -1e13, 1e300, 2.0, 3.0, 5e15])]
    vectors = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    low, high = -(2**63), 2**63 - 1
    ints = {i: [max(low, min(high, math.floor(x * 64))) for x in v] for i, v in given}
    want = set()
    for q in ints:
        scores = sorted((-max(low, min(high, sum(a * b for a, b in zip(ints[q], ints[i])))), i) for i in ints if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:4])}
    got = va_search.top_k(vectors, F.lit(True), k=4).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_groups_of_equal_bounds_are_read_whole_and_once():
    rng = np.random.default_rng(1)
    whole = rng.integers(-100, 100, (3000, 64))
    whole[:300] = whole[0]
    ids = rng.permutation(len(whole)).astype("int64")
    names = ids[ids % 20 == 0]
    points = whole[ids % 20 == 0]
    for name, point, got in zip(names, points, va_search._in_doubles(ids, whole.astype("float64"), names, points.astype("float64"), 20)):
        want = sorted((-s, i) for s, i in zip((whole @ point).tolist(), ids.tolist()) if i != name)[:20]
        assert [(-s, i) for i, s in zip(got.vec_id, got.score)] == want
