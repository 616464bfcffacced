"""Exact top-k by inner product with vector-approximation files.

Vectors and queries are dealt out to blocks. For each pair of blocks, one task holds the vectors twice:
as cells of a coarse grid (the approximation) and exactly. The scan of the cells gives an upper bound of
every score; exact vectors are then read in the order of their bounds until the k-th score found is
above every bound that is left (on a tie the reading goes on, so that the smaller id wins). The k best
of all blocks together are the result.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor
does one without an id; vectors of different lengths are never compared; a row that repeats an id is a
candidate of its own, but never for a query of that id; components beyond 64 bits count as the end of that
range, and so do scores, ties by id included; fewer candidates than k give fewer rows; an empty table
gives an empty result; columns other than the id and the vector play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block; a pair of blocks is what one task holds at a time.
VECTORS, QUERIES = 16_384, 2_048
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Cells of each dimension.
CELLS = 16
#: Queries bounded at once, and exact vectors read at once.
AT_ONCE, READ = 128, 64


def _scored(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block of vectors for each query of one block."""
    is_query = rows.is_query.to_numpy(bool)
    vectors, queries = rows[~is_query], rows[is_query]
    if not len(vectors) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    order = np.argsort(vectors.vec_id.to_numpy(), kind="stable")
    ids = vectors.vec_id.to_numpy()[order]
    whole, asked = np.stack(vectors.ints.to_numpy())[order], np.stack(queries.ints.to_numpy())
    most = math.isqrt(2**53 // whole.shape[1])  # products of these stay exact in a double
    wide, asks_wide = (((some > most) | (some < -most)).any(1) for some in (whole, asked))
    names = queries.vec_id.to_numpy()
    found = [
        *_in_doubles(ids[~wide], whole[~wide].astype("float64"), names[~asks_wide], asked[~asks_wide].astype("float64"), k),
        *_in_integers(ids[wide], whole[wide], names[~asks_wide], asked[~asks_wide], k),
        *_in_integers(ids, whole, names[asks_wide], asked[asks_wide], k),
    ]
    return pd.concat(found).astype("int64")


def _in_integers(ids: np.ndarray, whole: np.ndarray, names: np.ndarray, asked: np.ndarray, k: int) -> list[pd.DataFrame]:
    """The k best by scores of any size."""
    if not len(ids) or not len(names):
        return []
    found, exact = [], whole.astype(object)
    for name, point in zip(names, asked.astype(object)):
        scores = np.array([max(LOWEST, min(HIGHEST, x)) for x in exact @ point], "int64")
        at = np.flatnonzero(ids != name)
        at = at[np.lexsort((ids[at], ~scores[at]))[:k]]  # ~ turns the order round without an overflow
        found.append(pd.DataFrame({"query_id": name, "vec_id": ids[at], "score": scores[at]}))
    return found


def _in_doubles(ids: np.ndarray, exact: np.ndarray, names: np.ndarray, points: np.ndarray, k: int) -> list[pd.DataFrame]:
    """The k best by way of the cells."""
    if not len(ids) or not len(names):
        return []
    edges = np.quantile(exact, np.linspace(0, 1, CELLS + 1), axis=0)
    cells = np.stack([np.clip(np.searchsorted(edges[1:-1, d], exact[:, d], side="right"), 0, CELLS - 1) for d in range(exact.shape[1])], 1).astype("uint8")
    dims = np.arange(exact.shape[1])
    # In whole numbers, as the scores are: a bound that is rounded could fall below its score.
    low, high = np.floor(edges)[cells, dims].T, np.ceil(edges)[cells + 1, dims].T
    found = []
    for start in range(0, len(points), AT_ONCE):
        some = points[start:start + AT_ONCE]
        bounds = np.maximum(some, 0) @ high + np.minimum(some, 0) @ low
        for name, point, bound in zip(names[start:start + AT_ONCE], some, bounds):
            bound[ids == name] = -np.inf
            best_ids, best = _read(ids, exact, point, bound, k)
            found.append(pd.DataFrame({"query_id": name, "vec_id": best_ids, "score": best.astype("int64")}))
    return found


def _read(ids: np.ndarray, exact: np.ndarray, point: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact vectors in the order of their bounds, ever more at once, until the k-th score is certain."""
    n, done, step, above = len(bound), 0, max(READ, 2 * k), np.inf
    at, scores = np.empty(0, int), np.empty(0)
    while done < n:
        # All of one bound are read together, so none of them is read twice or left out.
        least = -np.inf if done + step >= n else -np.partition(-bound, done + step - 1)[done + step - 1]
        new = np.flatnonzero((bound >= least) & (bound < above) & (bound > -np.inf))
        at, scores = np.concatenate([at, new]), np.concatenate([scores, exact[new] @ point])
        best = np.lexsort((ids[at], -scores))[:k]
        at, scores = at[best], scores[best]
        done, above, step = int((bound >= least).sum()), least, step * 4
        if done < n and len(best) == k and bound[bound < least].max() < scores[-1]:
            break
    return ids[at], scores


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product with every query.

    `queries` says which rows are queries; all rows but the query's own id are candidates. Components
    become floor(scale * x). Vectors whose products would not stay exact in a double are scored in integers.
    """
    kept = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw"), F.coalesce(queries, F.lit(False)).alias("asks"))
        .where("vec_id is not null and size(raw) > 0")
        .where(F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .select("vec_id", "asks", F.size("raw").alias("n_dims"), F.transform("raw", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("ints"))
    )
    total, asking = kept.agg(F.count("*"), F.count_if("asks")).first()
    v_blocks, q_blocks = -(-total // VECTORS) or 1, -(-asking // QUERIES) or 1
    block = F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks)).cast("int")
    q_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    sides = kept.select(block.alias("v"), every(q_blocks).alias("q"), "n_dims", "vec_id", "ints", F.lit(False).alias("is_query")).unionByName(
        kept.where("asks").select(every(v_blocks).alias("v"), q_block.alias("q"), "n_dims", "vec_id", "ints", F.lit(True).alias("is_query"))
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        return _scored(rows, k)

    found = sides.groupBy("v", "q", "n_dims").applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
