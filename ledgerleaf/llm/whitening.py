"""Whitening of embeddings on the eigenvectors of their covariance.

Entries become whole numbers x. Sums are exact: a first scan adds up x by dimension; a second adds up the
products of x less the whole number nearest to its mean, in blocks small enough for doubles to hold every sum. What
the driver gathers is one number for each two dimensions, whatever the number of vectors, and the covariance it
makes of them is that of the vectors to the last bit of its own precision.

Eigenvectors come from a solver in 32-bit floats and are then corrected in extended precision by matrix
products alone (the iteration of Ogita and Aishima, which squares the error each time). Eigenvalues nearer to
each other than what the correction can tell apart make a cluster; the matrix seen by the cluster's vectors, shifted by the
cluster's mean, is a problem of its own with gaps of its own size, solved in the same way, and turns these vectors.

Defined cases: vectors that are null or hold null or non-finite entries take no part, nor do those with an
entry whose scaled size is 2 ** 40 or more (whole sums have room for no larger) or whose number of entries is not the most
common one (the smaller of equally common ones); vectors without entries are left out; a null id is an id like any other; repeated rows count
each; components without variance (of one vector, of equal vectors) are there, with null as whitened value, and play no part
in identity_error; a deviation that no long holds is null; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Scaled entries stay below this size.
LIMIT = 1 << 40
#: Products of whole doubles, and sums of them, are exact below this.
EXACT = 1 << 53
#: Eigenvalues at most this share of the trace for each dimension are taken as 0.
NOTHING = np.longdouble("1e-17")
#: Eigenvalues nearer than this share of the matrix are solved as a cluster.
CLEAR = 1e-9
Wide = np.longdouble


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One correction of approximate eigenvectors: eigenvalues, corrected vectors, and the pairs too near to tell apart."""
    n = len(a)
    r = np.eye(n, dtype=Wide) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    size = np.sqrt((a ** 2).sum())
    # Across a gap far above all rounding only, or else the correction would bring in more than it takes away.
    unclear = np.maximum(2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + size * np.sqrt((r ** 2).sum())), CLEAR * size)
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= unclear
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    return values, x + x @ e, near


def _clusters(values: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
    """Runs of falling eigenvalues, each near its neighbour."""
    order = np.argsort(-values, kind="stable")
    cuts = [k for k in range(1, len(order)) if not near[order[k - 1], order[k]]]
    return [run for run in np.split(order, cuts) if len(run) > 1]


def eigen(a: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in extended precision."""
    a = np.asarray(a, Wide)
    n = len(a)
    middle = np.trace(a) / max(n, 1)
    b = a - middle * np.eye(n, dtype=Wide)
    size = np.abs(b).max(initial=0)
    if n < 2 or size <= np.abs(a).max() * np.finfo(Wide).eps * n:
        return np.diag(a).copy(), np.eye(n, dtype=Wide)
    b = b / size
    x = np.linalg.eigh(b.astype("float32"))[1].astype(Wide)
    for turn in range(rounds):
        before = x
        values, x, near = _step(b, x)
        if turn >= 2:
            # A cluster's vectors may be any basis of their common space: its own small problem picks the right one.
            for run in _clusters(values, near):
                if len(run) == n and turn > 2:
                    continue
                basis = x[:, run]
                own = basis.T @ (b @ basis)
                x[:, run] = basis @ eigen((own + own.T) / 2)[1]
        if np.abs(x - before).max() <= 8 * np.finfo(Wide).eps:
            break
    for _ in range(2):  # nearest orthonormal vectors: what is left of rounding where gaps are below all precision
        x = x + x @ (np.eye(n, dtype=Wide) - x.T @ x) / 2
    x = x / np.sqrt((x ** 2).sum(axis=0))
    values = (x * (b @ x)).sum(axis=0) * size + middle
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order], x * np.where(x[np.abs(x).argmax(axis=0), np.arange(n)] < 0, -1, 1)


def products(y: np.ndarray) -> np.ndarray:
    """Sums of products of columns of whole numbers below 2 ** 42, as Python's whole numbers."""
    high = int(np.abs(y).max(initial=0))
    if high ** 2 < EXACT >> 10:
        total, step = np.zeros((y.shape[1],) * 2, object), EXACT // max(high ** 2, 1)
        for at in range(0, len(y), step):
            part = y[at:at + step].astype("float64")
            total = total + (part.T @ part).astype("int64").astype(object)
        return total
    top, low = y >> 21, y & ((1 << 21) - 1)
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), 1 << 10):
        t, u = top[at:at + (1 << 10)].astype("float64"), low[at:at + (1 << 10)].astype("float64")
        cross = (t.T @ u).astype("int64").astype(object)
        total = total + (t.T @ t).astype("int64").astype(object) * (1 << 42) + (cross + cross.T) * (1 << 21) + (u.T @ u).astype("int64").astype(object)
    return total


def _whole(column: pa.Array, dims: int, scale: int, shift: int) -> np.ndarray:
    values = np.asarray(column.flatten(), "float64").reshape(-1, dims)
    return np.floor(scale * values).astype("int64") + shift


def _sums(rows: DataFrame, fold, dims: int, scale: int, shift: int) -> dict[tuple[int, int], int]:
    """Add up, over all vectors, the matrix of whole numbers that `fold` makes of a block of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fold(_whole(batch.column(0), dims, scale, shift))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            values = [Decimal(int(v)) for v in total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["i", "j", "v"])

    found = rows.select("_vector").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return {(r.i, r.j): int(r.v) for r in found}


def covariance(n: int, sums: list[int], centre: list[int], moments: dict[tuple[int, int], int]) -> np.ndarray:
    """Exact sums to a covariance (divisor n) in extended precision."""
    dims = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre)]
    out = np.zeros((dims, dims), Wide)
    with localcontext() as context:
        context.prec = 60
        for i in range(dims):
            for j in range(i + 1):
                out[i, j] = out[j, i] = Wide(str(Decimal(n * moments[i, j] - rest[i] * rest[j]) / Decimal(n * n)))
    return out


def usable(vectors: DataFrame, scale: int, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector takes part, with it as `_vector` (doubles)."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < LIMIT))
    return vectors.withColumn("_vector", vector).where(F.col("_vector").isNotNull() & (F.size("_vector") > 0) & fit)


def whitened(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and each of the first components: the id, component (from 1), n,
    deviation (sum over dimensions of (n * x - sum) ** 2), whitened, explained and identity_error."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")), scale, vector_col).select(id_col, "_vector")
    common = rows.groupBy(F.size("_vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, n = common["dims"], common["count"]
    rows = rows.where(F.size("_vector") == dims)

    by_dim = _sums(rows, _column_sums, dims, scale, shift)
    sums = [by_dim[0, j] for j in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    nearest = np.array(centre, "int64")
    moments = _sums(rows, lambda x: products(x - nearest), dims, scale, shift)
    v = covariance(n, sums, centre, moments)
    values, basis = eigen(v)
    total = np.trace(v)
    k = min(components, dims)
    real = [bool(e > total * NOTHING * dims) for e in values[:k]]
    shares = [float(e / total) if real_one else 0.0 for e, real_one in zip(values[:k], real)]
    axes = np.array([basis[:, i] / np.sqrt(values[i]) if real[i] else basis[:, i] * 0 for i in range(k)], Wide).astype("float64").T
    offset = np.array([float(Decimal(s - n * c) / Decimal(n)) for s, c in zip(sums, centre)])
    rest = np.array([s - n * c for s, c in zip(sums, centre)], object)

    def white(x: np.ndarray) -> np.ndarray:
        return ((x - nearest) - offset) @ axes

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = white(_whole(batch.column(0), dims, scale, shift))
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    found = np.zeros((k + 1, k))
    for r in rows.select("_vector").mapInArrow(spread, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        found[r.i, r.j] = r.v / n
    off = np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k))[np.ix_(real, real)]
    error = float(off.max()) if off.size else None

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _whole(batch.column(1), dims, scale, shift)
            w = white(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()),
                pa.array([d for d in _deviations(x - nearest, n, rest) for _ in range(k)], pa.int64()),
                pa.array(w.ravel(), mask=np.tile(~np.array(real), m)),
                pa.array(np.tile(shares, m), pa.float64()),
                pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(give, schema)


def _column_sums(x: np.ndarray) -> np.ndarray:
    """Column sums of numbers below 2 ** 41, as one row of Python's whole numbers."""
    total = np.zeros((1, x.shape[1]), object)
    for at in range(0, len(x), 1 << 20):
        total = total + x[at:at + (1 << 20)].sum(axis=0).astype(object)
    return total


def _deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * y - rest) ** 2 for every row, exact; None if no long holds it."""
    high = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest.tolist()))
    if high ** 2 * y.shape[1] < 1 << 63:
        return ((n * y - rest.astype("int64")) ** 2).sum(axis=1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, rest.tolist())) for row in y.tolist()]
    return [d if d < 1 << 63 else None for d in found]
