import math

import numpy as np
import pytest

from ledgerleaf.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, _vector int, n string"


def orthonormal(n, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (np.eye(n) - q.T @ q) / 2
    return q


@pytest.mark.parametrize("values", [
    np.linspace(1, 40, 40), [5] * 10 + [5 + 1e-9, 5 + 2e-9, 5 + 1e-12] + [3] * 3 + [0.1, 0.2], [2.0] * 8,
    [0] * 5 + [1e-8, 1e-8 + 1e-15, 1], 10.0 ** np.arange(-12, 8), [1 + 1e-7 * k for k in range(30)], [4.0], [0.0, 0.0]])
def test_eigen(values):
    values = np.sort(np.array(values, float))[::-1]
    q = orthonormal(len(values))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(found - values).max() < 1e-17 * size
    assert np.abs(a @ x - x * found).max() < 1e-17 * size
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17


@pytest.mark.parametrize("high", [3, 1000, 1 << 30, (1 << 41) - 1])
def test_products_are_exact(high):
    y = np.random.default_rng(high).integers(-high, high + 1, (3000, 3))
    want = [[sum(a * b for a, b in zip(y[:, i].tolist(), y[:, j].tolist())) for j in range(3)] for i in range(3)]
    assert whitening.products(y).tolist() == want


def brute(vectors, k):
    x = np.floor(1024 * np.array(vectors, "float32").astype(float)).astype("int64") + 100_000
    n, sums = len(x), x.sum(axis=0)
    v = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = (x - sums / n) @ axes / np.sqrt(values)
    return white, ((n * x - sums) ** 2).sum(axis=1), values / np.trace(v)


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype("float32").tolist()
    bad = [None, [], [None] * 12, [math.nan] + [0.0] * 11, [math.inf] + [0.0] * 11, [1e30] + [0.0] * 11, [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, v) for i, v in enumerate(bad)]
    table = spark.createDataFrame([(i, v, "c", 5, None) for i, v in rows], SCHEMA).repartition(5)
    found = whitening.whitened(table).collect()
    assert len(found) == 300 * 8 and {r.n for r in found} == {300}
    white, deviation, shares = brute(vectors, 8)
    got = np.zeros((300, 8))
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(got - white * np.sign((got * white).sum(axis=0))).max() < 1e-9


def test_degenerate(spark):
    def rows(vectors):
        return whitening.whitened(spark.createDataFrame([(i, v, None, None, None) for i, v in enumerate(vectors)], SCHEMA)).collect()

    assert rows([]) == [] and rows([None]) == []
    one = rows([[1.0, 2.0, 3.0]])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(c, 1, 0, None, 0.0, None) for c in (1, 2, 3)]
    flat = rows([[1.0, 2.0], [2.0, 4.0], [2.0, 4.0], [1.0, 2.0]])
    assert len(flat) == 8 and {r.whitened for r in flat if r.component == 2} == {None}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in flat if r.component == 1) and flat[0].identity_error < 1e-12


def test_deviation_beyond_a_long(spark):
    table = spark.createDataFrame([(0, [1e9]), (1, [-1e9])], "vec_id long, embedding array<double>")
    # 1024 * 1e9 is above 2 ** 39 and below 2 ** 40: these take part, and their deviation has no room in a long
    assert [r.deviation for r in whitening.whitened(table).collect()] == [None, None]
