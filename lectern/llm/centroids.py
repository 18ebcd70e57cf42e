"""Centroid clustering of integer vectors with a LAESA pivot table.

The squared distance of each vector to a few fixed pivots is taken once and stored, as
its root, beside the vector. In each round the same is done for the centroids, on the
driver, and by the triangle inequality the difference of two roots bounds the distance
of vector and centroid from below. A vector takes the exact integer distance to the
centroid with the least bound, and to each other centroid whose bound does not exceed
it: bounds only leave work out, they never decide.

A round is one pass of the stored table. Each task folds its vectors into a count and
component sums for each centroid, so that a shuffle holds as many rows as there are
tasks and centroids, and the driver gets one row for each centroid.

Defined results: a vector is kept if it has exactly ``dims`` components, none of them
null, NaN, infinite or of 2**17 and more in size (beyond that no squared distance of it
fits a long); others are left out, as are rows with a null array. Rows with a null id
are clustered, but do not seed. Repeated ids are rows like others; among equal hashes
the smaller vector seeds first. Of equal distances the smaller centroid number wins. An
empty centroid stays where it is. With fewer kept ids than ``k`` there are as many
centroids as kept ids; with none the result is empty. No row depends on how many
columns the table has besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from lectern.llm.common import stored

#: Components times ``SCALE``, rounded down, are what distances are taken of.
SCALE = 1024
LARGEST = 2.0**17
PIVOTS = 8
#: Rows, by the hash of their id, that pivots are chosen from.
PIVOT_SAMPLE = 256
#: Share of two stored roots (of 24 bits) that their difference may be wrong by.
ROUNDING = 2e-7


@dataclass
class Clustering:
    """Final centroids (Python integers) and the work of each round, the last assignment included."""

    centroids: list[list[int]]
    vectors: int = 0
    exact: list[int] = field(default_factory=list)

    def digest(self, number: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[number])).encode()).hexdigest()


def kept(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    sound = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    return vectors.where((F.size(column) == dims) & sound)


def integers(cells: pa.ListArray, dims: int) -> np.ndarray:
    """(rows, dims) of an Arrow column of arrays without nulls."""
    return cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def squared(v: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one center, or to a center for each."""
    d = v - center
    return np.einsum("ij,ij->i", d, d)


def nearest(v: np.ndarray, roots: np.ndarray, centers: np.ndarray, center_roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, and how many exact distances that took."""
    low = np.zeros((len(v), len(centers)))
    for p, q in zip(roots.T, center_roots.T, strict=True):
        p = p[:, None].astype(np.float64)
        np.maximum(low, np.abs(p - q) - ROUNDING * (p + q), out=low)
    low *= low
    first = low.argmin(1)
    cluster, best, work = first.astype(np.int32), squared(v, centers[first]), len(v)
    for c in range(len(centers)):
        rows = np.flatnonzero((first != c) & (low[:, c] <= best))
        d = squared(v[rows], centers[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], c
        work += len(rows)
    return cluster, best, work


def by_hash(rows: DataFrame, seed: str, id: str, n: int) -> np.ndarray:
    """The ``n`` vectors whose ids hash lowest, in that order."""
    order = F.sha2(F.concat(F.lit(seed), F.col(id).cast("string")), 256)
    top = rows.where(F.col(id).isNotNull()).orderBy(order, "__v").select("__v").limit(n).collect()
    return np.array([r[0] for r in top], np.int64)


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows, each the one farthest from those before."""
    chosen = sample[:1]
    while 0 < len(chosen) < n:
        gap = np.min([squared(sample, c) for c in chosen], axis=0)
        if not gap.max():
            break
        chosen = np.concatenate([chosen, sample[gap.argmax()][None]])
    return chosen


def pivot_table(vectors: DataFrame, keep: Sequence[str], id: str, column: str, dims: int, pivots: int, seed: str) -> tuple[DataFrame, np.ndarray]:
    """The kept columns, integer vectors (``__v``) and roots of the distances to the pivots (``__r``), stored; the pivots."""
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = kept(vectors, column, dims).select(*keep, whole.alias("__v"))
    chosen = far_apart(by_hash(rows, f"pivot-{seed}", id, PIVOT_SAMPLE), pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = integers(batch.column(len(keep)), dims).astype(np.int64)
            roots = np.stack([np.sqrt(squared(v, p)) for p in chosen], 1) if len(chosen) else np.empty((len(v), 0))
            ends = np.arange(len(v) + 1, dtype=np.int32) * len(chosen)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(roots.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "__r"])

    schema = StructType([*rows.schema.fields, StructField("__r", ArrayType(FloatType()))])
    return stored(rows.mapInArrow(run, schema), "centroids-pivots"), chosen


def _roots(centers: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(squared(centers, p)) for p in pivots], 1) if len(pivots) else np.empty((len(centers), 0))


def _arrays(batch: pa.RecordBatch, dims: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_columns
    return integers(batch.column(n - 2), dims).astype(np.int64), integers(batch.column(n - 1), pivots) if pivots else np.empty((len(batch), 0))


def step(table: DataFrame, centers: np.ndarray, pivots: np.ndarray) -> tuple[list[list[int]], int, int]:
    """One round: the new centroids, the vectors, the exact distances taken."""
    k, dims = centers.shape
    center_roots = _roots(centers, pivots)
    names = [f"s{i}" for i in range(dims)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, work = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, roots = _arrays(batch, dims, len(pivots))
            cluster, _, n = nearest(v, roots, centers, center_roots)
            work[0] += n
            for c in range(k):
                mine = cluster == c
                counts[c] += mine.sum()
                sums[c] += v[mine].sum(0)
        columns = [np.arange(k), counts, work, *sums.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["c", "n", "work", *names])

    parts = table.select("__v", "__r").mapInArrow(fold, ", ".join(f"{c} long" for c in ["c", "n", "work", *names]))
    whole = parts.groupBy("c").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", "work", *names]])
    found = {r["c"]: [int(x) for x in r[1:]] for r in whole.collect()}
    new = []
    for c in range(k):
        n, _, *sums = found.get(c, [0, 0])
        new.append([s // n for s in sums] if n else [int(x) for x in centers[c]])
    return new, sum(r[0] for r in found.values()), sum(r[1] for r in found.values())


def clustered(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    column: str = "embedding",
    keep: Sequence[str] | None = None,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    pivots: int = PIVOTS,
    seed: str = "3:",
) -> tuple[DataFrame, Clustering]:
    """(``keep`` columns, cluster, distance) of each kept vector, stored, and the clustering.

    ``keep`` is the id alone by default; its columns must not be named cluster or distance.
    """
    keep = [id] if keep is None else list(keep)
    table, chosen = pivot_table(vectors, [*dict.fromkeys([id, *keep])], id, column, dims, pivots, seed)
    start = by_hash(table, seed, id, k).reshape(-1, dims)
    result = Clustering(start.tolist())
    fields = [table.schema[c] for c in keep]
    schema = StructType([*fields, StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if not len(start):
        return table.sparkSession.createDataFrame([], schema), result
    for _ in range(rounds):
        result.centroids, result.vectors, work = step(table, np.array(result.centroids, np.int64), chosen)
        result.exact.append(work)
    centers = np.array(result.centroids, np.int64)
    center_roots = _roots(centers, chosen)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, roots = _arrays(batch, dims, len(chosen))
            cluster, best, _ = nearest(v, roots, centers, center_roots)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], [*keep, "cluster", "distance"]
            )

    return stored(table.select(*keep, "__v", "__r").mapInArrow(assign, schema), "centroids-assigned"), result


def with_inertia(assigned: DataFrame, clustering: Clustering) -> DataFrame:
    """Adds the distance summed over each row's cluster and over all, and the digest of its centroid."""
    sums = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    numbers = range(len(clustering.centroids))
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")) if values else F.lit(None).cast(kind)
    return assigned.select(
        "*",
        at([sums.get(c, 0) for c in numbers], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        at([clustering.digest(c) for c in numbers], "string").alias("centroid_sha256"),
    )
