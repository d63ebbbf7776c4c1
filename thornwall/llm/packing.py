"""Packing of documents into sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length; what is left of each is a piece. Only the histogram of piece
lengths (at most ``capacity / grain`` classes) reaches the driver. A linear program over patterns (how many pieces of
each class share a sequence) is solved by the revised simplex method; a knapsack by dynamic programming prices new
columns. The rounded patterns make a table of slots, and the pieces, ranked within their class, take the slots.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thornwall.llm.common import parts, written
from thornwall.llm.tokens import encoder


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece; null text has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5,
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Knapsack:
    """Copies of each size (values, none negative) with the largest sum, for every room up to the capacity."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, capacity: int) -> None:
        self.order = np.argsort(sizes)
        self.sizes = sizes[self.order]
        values = values[self.order]
        self.best = np.zeros(capacity + 1)
        self.chosen = np.full(capacity + 1, -1)
        fits = np.searchsorted(self.sizes, np.arange(capacity + 1), side="right").tolist()
        for room in range(1, capacity + 1):
            self.best[room] = self.best[room - 1]
            if fits[room]:
                gains = self.best[room - self.sizes[: fits[room]]] + values[: fits[room]]
                n = gains.argmax()
                if gains[n] > self.best[room] + 1e-12:
                    self.best[room], self.chosen[room] = gains[n], n

    def pattern(self, room: int) -> np.ndarray:
        """The copies of each size that fill a room best."""
        copies = np.zeros(len(self.sizes), np.int64)
        while room > 0:
            n = self.chosen[room]
            if n < 0:
                room -= 1
            else:
                copies[self.order[n]] += 1
                room -= self.sizes[n]
        return copies


def first_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(square basis, amounts) that hold the demand exactly: sizes ascend, column j is led by size j.

    From the largest size down, a pattern takes as many of its size as fit and fills the room with smaller sizes, as far as
    their demand lasts for all of its sequences; so the basis is triangular and no amount is negative.
    """
    m = len(sizes)
    basis, amount, left = np.zeros((m, m)), np.zeros(m), demand.astype(float).copy()
    for j in range(m - 1, -1, -1):
        copies = capacity // sizes[j]
        basis[j, j] = copies
        amount[j] = left[j] / copies
        left[j] = 0
        room = capacity - copies * sizes[j]
        if amount[j] <= 0:
            continue
        for i in range(min(j, int(np.searchsorted(sizes, room, side="right"))) - 1, -1, -1):
            many = min(room // sizes[i], int(left[i] / amount[j]))
            if many > 0:
                basis[i, j] = many
                left[i] -= many * amount[j]
                room -= many * sizes[i]
                if room < sizes[0]:
                    break
    return basis, amount


def relaxed_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often) of the linear program: fewest sequences that hold the demand.

    ``sizes`` ascend. Revised simplex from patterns that fill one sequence after the other. A knapsack gives the best pattern that holds each size, and all of
    those that still price out enter one after the other. Stops when the sequences are within the share ``gap`` of the
    fewest: because no pattern prices out by more, or because all pieces end to end would fill as many. Where the steps run
    out first, a warning tells the share that is proven; the patterns hold the demand in any case.
    """
    m = len(sizes)
    basis, amount = first_patterns(sizes, demand, capacity)  # column j is pattern j
    inverse = np.linalg.inv(basis)
    costs = np.ones(m)  # a sequence per pattern; letting go of a surplus piece is free

    def enter(column: np.ndarray, cost: float) -> bool:
        nonlocal amount, inverse
        move = inverse @ column
        rising = move > 1e-9
        if not rising.any():
            return False
        ratios = np.where(rising, amount / np.where(rising, move, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        amount = np.maximum(amount - step * move, 0)
        amount[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[:, out] = column
        costs[out] = cost
        return True

    filled = float((sizes * demand).sum()) / capacity
    proven = np.inf  # share of the fewest sequences
    for _ in range(8 * m + 100):
        prices = costs @ inverse
        for _ in range(m):  # more than the demand of a size lets another pattern go
            if prices.min() >= -1e-9:
                break
            column = np.zeros(m)
            column[prices.argmin()] = -1
            if not enter(column, 0):
                break
            prices = costs @ inverse
        prices = prices.clip(0)
        sack = Knapsack(prices, sizes, capacity)
        used = amount[costs > 0].sum()
        proven = min(proven, sack.best[capacity], used / filled)
        if proven <= 1 + gap:
            break
        gains = prices + sack.best[capacity - sizes]
        entered = False
        for first in np.argsort(-gains)[:32].tolist():
            if gains[first] <= 1 + gap:
                break
            column = sack.pattern(capacity - int(sizes[first]))
            column[first] += 1
            if (costs @ inverse) @ column > 1 + gap:
                entered = enter(column, 1) or entered
        if not entered:
            break
    if proven > 1 + gap:
        warnings.warn(f"packing patterns are proven to be within {proven - 1:.1%} of the fewest sequences only", stacklevel=2)
    real = costs > 0
    return basis[:, real].T.astype(np.int64), amount[real]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern {size: copies}, times)] with room for every piece of the histogram."""
    left = {size: many for size, many in histogram.items() if many}
    made: list[tuple[dict[int, int], int]] = []
    if not left:
        return made
    if capacity in left:
        made.append(({capacity: 1}, left.pop(capacity)))
    if left:
        sizes = np.array(sorted(left), np.int64)
        demand = np.array([left[s] for s in sizes.tolist()], np.int64)
        patterns, amounts = relaxed_patterns(sizes, demand.astype(float), capacity)
        for k in np.argsort(-amounts):
            pattern = patterns[k]
            used = pattern > 0
            times = min(int(amounts[k] + 1e-6), int((demand[used] // pattern[used]).min())) if used.any() else 0
            if times:
                demand -= times * pattern
                made.append(({int(s): int(n) for s, n in zip(sizes[used], pattern[used], strict=True)}, times))
        # What rounding left, at most about one sequence per pattern: largest first.
        while demand.any():
            room, pattern = capacity, {}
            for n in range(len(sizes) - 1, -1, -1):
                take = int(min(demand[n], room // sizes[n]))
                if take:
                    pattern[int(sizes[n])] = take
                    room -= take * int(sizes[n])
            used = np.array([pattern.get(int(s), 0) for s in sizes])
            times = int((demand[used > 0] // used[used > 0]).min())
            demand -= times * used
            made.append((pattern, times))
    return made


def _slots(made: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first ranks of its runs of slots, their first sequences, copies per sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, times in made:
        for size, copies in pattern.items():
            runs.setdefault(size, []).append((ranks.get(size, 0), first, copies))
            ranks[size] = ranks.get(size, 0) + copies * times
        first += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in runs.items()}


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    grain: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to), one row per piece.

    Every id of every document lies in one piece and every piece in one sequence of at most ``capacity`` ids. Lengths
    count in steps of ``grain`` in the linear program, so a piece wastes less than ``grain`` ids of a plan; offsets are
    gapless all the same. padded_to is ``capacity``, or the ids of the sequence where these are a power of two. Null
    and empty texts have the end id alone. Repeated rows and null ids are packed like any other. An empty table gives
    no rows.
    """
    many = parts(docs.sparkSession)
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    size = F.ceil(F.col("length") / F.lit(grain)).cast("long")
    order = ["size", "doc_id", "start", "ids_crc32"]
    ranged = pieces.withColumn("size", size).repartitionByRange(many, *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    counts = ranged.groupBy("size", "part").agg(F.count("*").alias("many"))
    histogram = {row.size: row.many for row in counts.groupBy("size").agg(F.sum("many").alias("many")).collect()}
    slots = _slots(plan(histogram, capacity // grain))

    # A class lies in neighbouring partitions, so this has as many rows as there are classes and partitions.
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("size", "part", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("size", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranged.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(counts), ["size", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            found = np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes):
                rows = np.flatnonzero(sizes == s)
                begins, first, copies = slots[int(s)]
                run = np.searchsorted(begins, ranks[rows], side="right") - 1
                found[rows] = first[run] + (ranks[rows] - begins[run]) // copies[run]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=[*names, "sequence_id"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.mapInArrow(place, ", ".join(f"{name} long" for name in [*names, "sequence_id"]))
    sequence = Window.partitionBy("sequence_id")  # at most `capacity` pieces
    before = sequence.orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("length").over(sequence)
    return placed.select(
        *names,
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        F.when(F.bit_count(total) == 1, total).otherwise(F.lit(capacity)).alias("padded_to"),
    )
