"""Clustering around centroids in integers, with a filter in rotated coordinates.

Vectors become integers once. A principal-component rotation, learnt from the sums over all vectors, gives each vector
its leading coordinates and the norm of what is left; the squared distance of the leading coordinates plus the squared
difference of the residual norms never exceeds the squared distance, so most centroids are ruled out without a look at
the vector. Those left are compared in integers, so assignments, sums and centroids are exact and alike at every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwall.llm.common import written

#: Integers beyond this would give distances that a long can't hold.
LARGEST = 1 << 27


@dataclass
class Rotation:
    """The mean of all vectors and the directions of their largest variance, as columns."""

    mean: np.ndarray
    axes: np.ndarray

    def project(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leading coordinates, norm of the rest) of each row."""
        moved = cells - self.mean
        lead = moved @ self.axes
        return lead, np.sqrt(np.maximum((moved**2).sum(1) - (lead**2).sum(1), 0))


def cells_of(vectors: DataFrame, id_col: str, vec_col: str, size: int, scale: int) -> DataFrame:
    """(vec_id, cells binary) of the vectors that take part: little-endian 32-bit integers floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), size), False)
            batch = batch.filter(fits)
            flat = pc.list_flatten(batch.column(1))
            values = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)  # null becomes NaN
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(values * scale)
                good = (np.abs(whole) <= LARGEST).all(1)  # false for NaN and infinity
            rows = whole[good].astype("<i4")
            cells = pa.array([row.tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), cells], names=["vec_id", "cells"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("cells"))
    return narrow.mapInArrow(run, "vec_id long, cells binary")


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def _sums(rows: DataFrame, run, kind: str, size: int) -> dict[int, tuple[int, list]]:
    """{key: (many, sums)} of what tasks emit as (key, many, values); as many rows reach the driver as there are keys."""
    partial = rows.mapInArrow(run, f"key long, many long, values array<{kind}>")
    sums = [F.sum(F.col("values")[i]) for i in range(size)]
    found = partial.groupBy("key").agg(F.sum("many").alias("many"), F.array(*sums).alias("values")).collect()
    return {row.key: (row.many, row["values"]) for row in found}


def _partial(keys: list[int], many: list[int], values: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    lists = pa.array(list(values), pa.list_(kind))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(many, pa.int64()), lists], names=["key", "many", "values"])


def rotation(cells: DataFrame, size: int, lead: int) -> Rotation | None:
    """The rotation of all vectors; each task sends one matrix of products, None without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros((size + 1, size)), 0
        for batch in batches:
            rows = _matrix(batch.column(0), size).astype(float)
            total[:size] += rows.T @ rows
            total[size] += rows.sum(0)
            many += len(rows)
        if many:
            yield _partial(list(range(size + 1)), [many] * (size + 1), total, pa.float64())

    found = _sums(cells.select("cells"), run, "double", size)
    if not found:
        return None
    many = found[size][0]
    mean = np.array(found[size][1]) / many
    spread = np.array([found[i][1] for i in range(size)]) / many - np.outer(mean, mean)
    values, axes = np.linalg.eigh((spread + spread.T) / 2)
    return Rotation(mean, axes[:, np.argsort(-values, kind="stable")[:lead]])


class Assigner:
    """Finds the nearest of some centroids (rows of integers); counts the distances that were computed in full."""

    def __init__(self, centroids: np.ndarray, turned: Rotation) -> None:
        self.centroids = centroids
        self.lead, self.rest = turned.project(centroids)
        self.computed = 0

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of each row to each centroid, less what rounding may add."""
        squares = (lead**2).sum(1)[:, None] + (self.lead**2).sum(1)
        apart = squares - 2 * lead @ self.lead.T + (rest[:, None] - self.rest) ** 2
        return apart - 1e-9 * (squares + rest[:, None] ** 2 + self.rest**2 + 1)

    def nearest(self, cells: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row; of equally near centroids that with the smaller number."""
        bounds = self.bounds(lead, rest)
        first = bounds.argmin(1)
        best = ((cells - self.centroids[first]) ** 2).sum(1)
        self.computed += len(cells)
        # in ascending order of number, so a tie moves to a smaller number only if the first look gave a larger one
        cluster = first.copy()
        for number, centroid in enumerate(self.centroids):
            rows = np.flatnonzero((bounds[:, number] <= best) & (first != number))
            apart = ((cells[rows] - centroid) ** 2).sum(1)
            self.computed += len(rows)
            better = (apart < best[rows]) | (apart == best[rows]) & (number < cluster[rows])
            best[rows[better]], cluster[rows[better]] = apart[better], number
        return cluster, best


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    scale: int = 64,
    lead: int = 16,
    seed: int = 1,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    These have ``size`` components, none null or non-finite, whose integers lie within 2^27. Centroids start as the
    vectors with the ``k`` smallest sha256 of ``seed:vec_id`` (fewer vectors: all); of repeated ids the one with the smaller
    components comes first. A vector with a null id is assigned but starts nothing. A sum of distances beyond a long is
    null. No such vector: no rows. Other columns are not read.
    """
    cells = cells_of(vectors, id_col, vec_col, size, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = cells.where("vec_id is not null").select(order.alias("order"), "cells").orderBy("order", "cells").limit(k).collect()
    turned = rotation(cells, size, lead) if starts else None
    shape = "vec_id long, cluster int, distance long"
    if turned is None:
        found = vectors.sparkSession.createDataFrame([], shape)
        return found.select("*", F.lit(None).cast("long").alias("cluster_inertia"), F.lit(None).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    centroids = np.array([np.frombuffer(row.cells, "<i4") for row in starts]).astype(np.int64)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leading, rest = turned.project(_matrix(batch.column(1), size))
            columns = [*batch.columns, pa.array([row.tobytes() for row in leading], pa.binary()), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cells", "lead", "rest"])

    rows = written(cells.mapInArrow(rotate, "vec_id long, cells binary, lead binary, rest double"), "rotated")

    def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
        assigner = Assigner(centroids, turned)
        for batch in batches:
            if batch.num_rows:
                whole = _matrix(batch.column(1), size)
                leading = np.frombuffer(b"".join(batch.column(2).to_pylist()), float).reshape(len(whole), -1)
                yield batch.column(0), whole, *assigner.nearest(whole, leading, batch.column(3).to_numpy())

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centroids), size), np.int64)
            many = np.zeros(len(centroids), np.int64)
            for _, whole, numbers, _ in assigned(batches, centroids):
                np.add.at(total, numbers, whole)
                many += np.bincount(numbers, minlength=len(many))
            used = np.flatnonzero(many)
            yield _partial(used.tolist(), many[used].tolist(), total[used], pa.int64())

        centroids = centroids.copy()
        for number, (many, values) in _sums(rows, sums, "long", size).items():
            centroids[number] = [value // many for value in values]  # of whole numbers: the floor

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, numbers, apart in assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers.astype(np.int32)), pa.array(apart)], names=["vec_id", "cluster", "distance"])

    found = written(rows.mapInArrow(label, shape), "assigned")
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows
    totals = {row.cluster: int(row.total) for row in by_cluster}

    def fitting(value: int):
        return F.lit(value if value < 1 << 63 else None).cast("long")

    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*[fitting(totals.get(n, 0)) for n in range(len(names))]), at).alias("cluster_inertia"),
        fitting(sum(totals.values())).alias("inertia"),
        F.element_at(F.array(*map(F.lit, names)), at).alias("centroid_sha256"),
    )
