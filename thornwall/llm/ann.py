"""Nearest neighbours by inner product with an inverted multi-index.

Both halves of the vectors are quantised on their own; a pair of centroids names a cell. A query walks the cells in
the order of summed distance (the inner products with the two centroids, negated) with a heap, until the cells hold
enough entries, and those entries are reranked with exact scores. Entries are grouped into at most ``GROUP`` rows, a
crowded cell being split over several, so no task depends on how full a cell is. Each entry moves once: a task holds the
entries of one group at a time and streams the queries that visit it, which follow them in the sorted partition.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thornwall.llm.common import parts, written

GROUP, STEP = 16384, 256


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>) of the vectors that can take part.

    Left out are null ids, null, empty and zero vectors, and vectors with a null or non-finite component.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = "exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return rows.where("vec_id is not null and vector is not null").where(f"not {bad} and exists(vector, x -> x <> 0)")


def centroids(rows: np.ndarray, many: int, rounds: int = 12) -> np.ndarray:
    """k-means from a fixed start; empty clusters keep their old centre."""
    centres = rows[np.random.default_rng(0).choice(len(rows), min(many, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = (2 * rows @ centres.T - (centres**2).sum(1)).argmax(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * len(right) + j) by rising left[i] + right[j] until they hold ``wanted`` entries."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap = [(float(left[a[0]] + right[b[0]]), 0, 0)]
    found: list[int] = []
    seen = 0
    while heap and seen < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(right) + int(b[j])
        if counts[cell]:
            found.append(cell)
            seen += int(counts[cell])
        # Every pair but the first has one parent: (i, j - 1), or (i - 1, 0) in the first column.
        if j + 1 < len(b):
            heapq.heappush(heap, (float(left[a[i]] + right[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (float(left[a[i + 1]] + right[b[0]]), i + 1, 0))
    return found


def _best(scores: np.ndarray, queries: np.ndarray, entries: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, ids, scores) of the k best entries of each query by exact score, ties to the smaller id."""
    for n in range(len(scores)):
        row = scores[n]
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            # Sums differ in the last digits with their order, so near ties are scored alike below.
            chosen = np.flatnonzero((row >= edge - 1e-9 * (1 + abs(edge))) & (row > -np.inf))
        else:
            chosen = np.flatnonzero(row > -np.inf)
        exact = (entries[chosen] * queries[n]).sum(1)
        order = np.lexsort((ids[chosen], -exact))[:k]
        yield n, ids[chosen][order], exact[order]


def cells_for(rows: int, least: int) -> int:
    """Centroids per half: by the fourth root, so that their pairs grow with the square root of the rows.

    64 up to 10,000 rows, 1,138 for a thousand million.
    """
    return max(least, round(6.4 * rows**0.25))


def left_out(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(length, vectors, searched): how many valid vectors each length has, and whether ``nearest`` searches them."""
    lengths = vectors_of(table, id_col, vector_col).groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("vectors"))
    most = lengths.agg(F.max(F.struct("vectors", "length"))["length"].alias("most"))
    return lengths.join(most, F.col("length") == F.col("most"), "left").select("length", "vectors", F.col("most").isNotNull().alias("searched"))


def nearest(
    table: DataFrame,
    k: int = 20,
    every: int = 20,
    cells: int = 64,
    share: float = 0.55,
    sample: int = 20000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with an id divisible by ``every`` its k nearest others found.

    ``cells`` centroids per half, more from 10,000 rows on (``cells_for``), are fitted on ``sample`` rows at most (those
    with the smallest hash of the id); all rows are indexed. A query looks through cells that hold ``share`` of all rows, and 4 k at least: vectors
    without much structure, as here, need that for a recall of 0.9. Scores are inner products of the original vectors
    in double precision. Vectors of another length than the commonest (of equally
    common ones the largest) take no part; ``left_out`` counts them. Rows of one id are
    one entry each, and none of them is a candidate of a query with that id. Equal scores rank by the smaller id. An empty
    table has an empty result.
    """
    spark = table.sparkSession
    valid = vectors_of(table, id_col, vector_col)
    lengths = valid.groupBy(F.size("vector").alias("length")).count()
    some = lengths.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not some:
        return spark.createDataFrame([], schema)
    size = some[0].length
    half = size // 2
    valid = valid.where(F.size("vector") == size)
    fitted = np.array([r.vector for r in valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()])
    many = cells_for(some[0]['count'], cells)
    centres = [centroids(x, min(many, max(1, len(x) // 4))) for x in (fitted[:, :half], fitted[:, half:])]
    wide = len(centres[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(1).flatten().to_numpy()).reshape(-1, size)
            near = [(2 * x @ c.T - (c**2).sum(1)).argmax(1) for x, c in zip((rows[:, :half], rows[:, half:]), centres, strict=True)]
            packed = pa.array([row.tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(near[0] * wide + near[1])], names=["vec_id", "vector", "cell"])

    entries = written(valid.mapInArrow(assign, "vec_id long, vector binary, cell long"), "entries")
    counts = np.zeros(len(centres[0]) * wide, np.int64)
    for cell, many in entries.groupBy("cell").count().collect():  # at most a row per cell
        counts[cell] = many
    total = int(counts.sum())
    wanted = max(int(share * total), 4 * k)
    # Cells are laid end to end and cut into groups; a crowded cell spans several, its entries dealt by id.
    begin = np.cumsum(counts) - counts
    first, last = begin // GROUP, (begin + np.maximum(counts, 1) - 1) // GROUP
    fields = ["task", "kind", "vec_id", "vector", "cell", "cells"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry goes to one group of its cell."""
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            group = first[cell] + (mixed.astype(np.int64) % (last[cell] - first[cell] + 1))
            columns = [pa.array(group), pa.array(np.zeros(len(cell), np.int32)), batch.column("vec_id"), batch.column("vector"), batch.column("cell")]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(cell), pa.binary())], names=fields)

    def laid(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=fields)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes to every group that holds one of its cells, with the list of those cells."""
        for batch in batches:
            out: list[tuple] = []
            for query, raw in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                vector = np.frombuffer(raw)
                found = np.array(walk(-(centres[0] @ vector[:half]), -(centres[1] @ vector[half:]), counts, wanted), np.int32)
                lists: dict[int, list[int]] = {}
                for cell in found.tolist():
                    for group in range(first[cell], last[cell] + 1):
                        lists.setdefault(int(group), []).append(cell)
                out += [(g, 1, query, raw, None, np.array(c, np.int32).tobytes()) for g, c in lists.items()]
                if len(out) > STEP:
                    yield laid(out)
                    out = []
            yield laid(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, its entries before its queries."""
        group, entries_of, held, ids, names, place = None, [], None, None, None, None
        for batch in batches:
            task, kind = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(task) != 0) | (np.diff(kind) != 0)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(task)], strict=True):
                if at == end:
                    continue
                if task[at] != group:
                    group, entries_of, held = task[at], [], None
                if kind[at] == 0:
                    entries_of.append(batch.slice(at, end - at))
                    continue
                if not entries_of and held is None:
                    continue
                if held is None:
                    rows = pa.Table.from_batches(entries_of)
                    ids, held = rows["vec_id"].to_numpy(), np.frombuffer(b"".join(rows["vector"].to_pylist())).reshape(-1, size)
                    names, place = np.unique(rows["cell"].to_numpy(), return_inverse=True)
                    entries_of = []
                for start in range(at, end, STEP):
                    part = batch.slice(start, min(end, start + STEP) - start)
                    vectors = np.frombuffer(b"".join(part["vector"].to_pylist())).reshape(-1, size)
                    query_ids = part["vec_id"].to_numpy()
                    visits = np.zeros((len(vectors), len(names)), bool)
                    for n, raw in enumerate(part["cells"].to_pylist()):
                        visits[n] = np.isin(names, np.frombuffer(raw, np.int32))
                    scores = vectors @ held.T
                    scores[~visits[:, place] | (query_ids[:, None] == ids)] = -np.inf
                    best = list(_best(scores, vectors, held, ids, k))
                    columns = [np.repeat(query_ids, [len(b) for _, b, _ in best]), *(np.concatenate([b[i] for b in best]) for i in (1, 2))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    moved = "task long, kind int, vec_id long, vector binary, cell long, cells binary"
    queries = entries.where(F.col("vec_id") % every == 0).mapInArrow(asked, moved)
    many = max(1, min(4 * parts(spark), int(last.max() + 1)))
    both = entries.mapInArrow(dealt, moved).unionByName(queries).repartition(many, "task")
    found = both.sortWithinPartitions("task", "kind", "vec_id").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows per group
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
