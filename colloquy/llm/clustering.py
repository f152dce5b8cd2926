"""Centroid clustering by Lloyd's rounds in exact integers, with Hamerly's bounds.

A component x of a vector becomes the integer floor(scale * x). The first
centroids are the vectors with the smallest hashes of their ids. Each round
assigns all vectors, then replaces every non-empty centroid by the floor of the
mean of its vectors.

What a vector carries from round to round, in a written table: its cluster, an
upper bound of the distance to its centroid, and one lower bound of the distance
to the second-nearest one. After an update the upper bound grows by the drift of
the own centroid and the lower one shrinks by the largest drift of the others.
While the upper bound is strictly below the lower one, or below half the way
from the own centroid to the next, the assignment can't have changed, ties
included. Else the own distance is computed; if that doesn't decide, the vector
is ambiguous and is compared with all centroids in exact integers. Bounds are
floats, widened beyond their rounding; they only say who needs no comparison.

A round is one pass over the table and an aggregation of partial sums: a task
hands on one row for each (cluster, dimension), so a cluster that holds most
vectors is no hot key. Only centroids (clusters * dims integers) come to the
driver.

Defined results: vectors of another length, or with a null or non-finite
component, aren't kept, and nor are null vectors. A null id hashes as an empty
one. Equal hashes (repeated rows) are taken in the order of their components, so
repeated vectors may be several first centroids; ties go to the smaller number,
and an empty cluster keeps its centroid. With fewer vectors than clusters there
are as many clusters as vectors. An empty table gives no rows. Other columns are
ignored. A scaled component beyond 2**27 raises an error, as squared distances
wouldn't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, written

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Largest scaled component: 4 * LIMIT ** 2 * 64 is below 2 ** 63.
LIMIT = 1 << 27
#: Up to this component, sums of 64 products are exact in floats too.
FLOAT_EXACT = 1 << 22
#: Rows that a task compares with all centroids at once.
BLOCK = 1 << 14
#: Relative width that covers the rounding of bounds.
ROUNDING = 1e-12


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    small = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= FLOAT_EXACT
    x, c = x.astype(np.int64), centroids.astype(np.int64)
    products = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if small else np.stack([(x * row).sum(axis=1) for row in c], axis=1)
    return (x * x).sum(axis=1)[:, None] - 2 * products + (c * c).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller), upper and lower bound, by comparing with all."""
    d = squared(x, centroids)
    rows = np.arange(len(x))
    own = d.argmin(axis=1)
    upper = np.sqrt(d[rows, own].astype(np.float64)) * (1 + ROUNDING)
    if len(centroids) == 1:
        return own, upper, np.full(len(x), np.inf)
    d[rows, own] = np.iinfo(np.int64).max
    return own, upper, np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - ROUNDING)


class Bounds:
    """What the bounds need of a round's centroids: how far they moved, and half the way to the nearest other one."""

    def __init__(self, before: np.ndarray, now: np.ndarray):
        moved = np.sqrt(((now - before).astype(object) ** 2).sum(axis=1).astype(np.float64)) * (1 + ROUNDING)
        k = len(now)
        apart = squared(now, now).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.centroids, self.moved = now, moved
        self.others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(k)])
        self.half = np.sqrt(apart.min(axis=1)) / 2 * (1 - ROUNDING)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New numbers and bounds, and which rows were compared with all centroids."""
        own, upper, lower = own.copy(), (upper + self.moved[own]) * (1 + ROUNDING), (lower - self.others[own]) * (1 - np.sign(lower - self.others[own]) * ROUNDING)
        sure = np.maximum(lower, self.half[own])
        at = np.flatnonzero(~(upper < sure))
        upper[at] = np.sqrt(own_distance(x[at], self.centroids[own[at]]).astype(np.float64)) * (1 + ROUNDING)
        at = at[~(upper[at] < sure[at])]
        for part in np.split(at, range(BLOCK, len(at), BLOCK)):
            own[part], upper[part], lower[part] = nearest(x[part], self.centroids)
        scanned = np.zeros(len(x), dtype=bool)
        scanned[at] = True
        return own, upper, lower, scanned


def own_distance(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) - centroids) ** 2).sum(axis=1)


def _first_round(vectors: DataFrame, centroids: np.ndarray, scale: int, schema: T.StructType) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                x = scaled(_matrix(part.column(1), dims), scale)
                own, upper, lower = nearest(x, centroids)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(np.ones(len(x), bool))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        whole = np.floor(scale * values)
    if np.abs(whole).max(initial=0) > LIMIT:
        raise ValueError(f"a scaled component is beyond {LIMIT}; squared distances would not fit a long")
    return whole.astype(np.int32)


def _next_round(state: DataFrame, bounds: Bounds, schema: T.StructType) -> DataFrame:
    dims = bounds.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, upper, lower = (batch.column(k).to_numpy() for k in (2, 3, 4))
            own, upper, lower, scanned = bounds.assign(_matrix(batch.column(1), dims), own, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned)], names=schema.names)

    return state.mapInArrow(run, schema)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: componentwise floor of the mean, exact; those without vectors stay."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dims).astype(np.int64)
            counts += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            found, at = np.unique(own[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(x[order], at, axis=0)
        rows, columns = np.nonzero(np.broadcast_to(counts[:, None] > 0, sums.shape))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(counts[rows]), pa.array(sums[rows, columns])], names=["cluster", "dim", "n", "total"])

    parts = state.select("cluster", "x").mapInArrow(partial, "cluster int, dim int, n long, total long")
    out = centroids.copy()
    # at most clusters * dims rows
    for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster, r.dim] = int(r.total) // int(r.n)
    return out


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1"
) -> DataFrame:
    """key, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256, and scanned: whether the last assignment compared it with all centroids."""
    spark = vectors.sparkSession
    values = F.col(f"`{vector}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{key}`").alias("id"), values.alias("v")).filter(
        (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    chosen = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)).orderBy("h", "v").limit(clusters)
    centroids = np.array([scaled(np.array(r.v), scale) for r in chosen.select("v").collect()], dtype=np.int64).reshape(-1, dims)
    kind = vectors.schema[key].dataType
    result = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned boolean").fields])
    if not len(centroids):
        return spark.createDataFrame([], result)
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("x array<int>, cluster int, upper double, lower double, scanned boolean").fields])
    with Scratch(spark, "clustering") as scratch:
        state = scratch.table(_first_round(kept, centroids, scale, schema), "round")
        for _ in range(rounds):
            before, centroids = centroids, _means(state, centroids)
            last, state = state, scratch.table(_next_round(state, Bounds(before, centroids), schema), "round")
            scratch.drop(last)
        found = written(_distances(state, centroids, kind), "clustering")
    # one row for each cluster
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(len(centroids))]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), *result.names[1:])


def _distances(state: DataFrame, centroids: np.ndarray, kind: T.DataType) -> DataFrame:
    dims = centroids.shape[1]
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("cluster int, distance long, scanned boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = own_distance(_matrix(batch.column(1), dims), centroids[batch.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(distance), batch.column(3)], names=schema.names)

    return state.select("id", "x", "cluster", "scanned").mapInArrow(run, schema)
