"""Vector distances and nearest neighbours over array columns, in double precision."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import EntitySpec

COSINE, L2, INNER = "cosine", "l2", "inner"


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine: 1 - cos, 1 for a zero vector; l2: Euclidean; inner: negative dot product.

    Vectors of unequal length have no distance (null).
    """
    a, b = _doubles(a), _doubles(b)
    if metric == COSINE:
        norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
        value = F.when(norms == 0, F.lit(1.0)).otherwise(1 - _dot(a, b) / norms)
    elif metric == L2:
        value = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    elif metric == INNER:
        value = -_dot(a, b)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.when(F.size(a) == F.size(b), value)


def nearest(df: DataFrame, spec: EntitySpec, column: str, query: list[float], metric: str, k: int) -> DataFrame:
    """All columns and the distance of the k nearest rows; the key breaks ties. Plan: one scan and a top-k."""
    found = df.withColumn("distance", distance(F.col(column), F.array(*[F.lit(float(x)) for x in query]), metric))
    return found.filter("distance is not null").orderBy("distance", *spec.primary_key).limit(k)


def _matrix(column: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the right dimension as a matrix, their places)."""
    at = np.array([k for k, v in enumerate(column) if v is not None and len(v) == dim], np.int64)
    return (np.array([column.iloc[k] for k in at], np.float64) if len(at) else np.empty((0, dim))), at


def _distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two sets of vectors, as in ``distance``."""
    dots = rows @ queries.T
    if metric == INNER:
        return -dots
    a, b = (rows * rows).sum(1), (queries * queries).sum(1)
    if metric == L2:
        near = a[:, None] + b[None, :] - 2 * dots
        i, j = np.nonzero(near < 1e-6 * (a[:, None] + b[None, :]))  # cancelled digits: from the differences instead
        near[i, j] = ((rows[i] - queries[j]) ** 2).sum(1)
        return np.sqrt(np.maximum(near, 0))
    norms = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
    return np.where(norms == 0, 1.0, 1 - dots / np.where(norms == 0, 1, norms))


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """Whether each distance is among the k least of its column; ties stay."""
    return found <= (np.partition(found, k - 1, axis=0)[k - 1] if len(found) > k else np.inf)


def _query_blocks(queries: DataFrame, query_id: str, column: str, block: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries in blocks of about ``block`` by hash, as (ids, matrix) of each dimension in the block."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(column).cast("array<double>").alias("q")).filter("q is not null")
    n = max(1, -(-q.count() // max(1, block // 2)))
    for k in range(n):
        part = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).toPandas()
        if len(part):
            yield {int(dim): (of["query_id"].to_numpy(), np.array(of["q"].tolist(), np.float64).reshape(-1, int(dim))) for dim, of in part.groupby(part["q"].map(len))}


def nearest_batch(df: DataFrame, spec: EntitySpec, column: str, queries: DataFrame, query_id: str, metric: str, k: int, block: int = 10_000) -> DataFrame:
    """(query id, key, distance, rank) of the k nearest rows of each query; the key breaks ties.

    The queries go to every task in blocks of about ``block`` by hash, however many there are: one pass over the rows
    for each block. A task works out the distances of a batch of rows as one matrix product and passes on the best k
    of each query, so what is shuffled is bounded by queries times batches. Vectors of another dimension have no distance.
    """
    if metric not in (COSINE, L2, INNER):
        raise ValueError(f"unknown metric {metric!r}")
    rows = df.select(*spec.primary_key, F.col(column).alias("_v")).filter("_v is not null")
    kinds = dict(df.dtypes)
    out = f"query_id {dict(queries.dtypes)[query_id]}, " + ", ".join(f"{c} {kinds[c]}" for c in spec.primary_key) + ", distance double"
    parts = []
    for block_of in _query_blocks(queries, query_id, column, block):
        shared = df.sparkSession.sparkContext.broadcast(block_of)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start, (names, q) in itertools.product(range(0, len(batch), 2000), shared.value.values()):
                    piece = batch.iloc[start : start + 2000]
                    vectors, at = _matrix(piece["_v"], q.shape[1])
                    for first in range(0, len(q), 2000):
                        found = _distances(vectors, q[first : first + 2000], metric)
                        i, j = np.nonzero(_best(found, k)) if len(vectors) else (np.empty(0, np.int64),) * 2
                        best = piece[list(spec.primary_key)].iloc[at[i]].reset_index(drop=True)
                        best.insert(0, "query_id", names[first + j])
                        best["distance"] = found[i, j] if len(vectors) else []
                        yield best

        parts.append(rows.mapInPandas(run, out))
    if not parts:
        return df.sparkSession.createDataFrame([], out + ", rank int")
    w = Window.partitionBy("query_id").orderBy("distance", *spec.primary_key)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def audit_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector has another dimension than declared."""
    return df.filter(F.size(column) != dim)
