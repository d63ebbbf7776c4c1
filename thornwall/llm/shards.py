"""Shards of near equal bytes: the minimax contiguous partition of ordered groups of equal texts.

Groups of equal texts, in the order of their smallest id, are atomic. The capacity is the smallest with which filling
shards greedily in that order needs no more than the wanted number; it is found by binary search over the prefix sums
of the group sizes. The prefix sums stay distributed: the driver sees a ladder of at most ``LADDER`` blocks of them
and refines only the blocks in which a cut may fall, until every cut is exact. DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thornwall.llm.common import parts, written

#: Blocks of prefix sums that the driver holds after each round, about.
LADDER = 8192


class Ladder:
    """What is known of the sorted prefix sums: spans (first, last, count, shift), read in finer steps on demand."""

    def __init__(self, sums: DataFrame, total: int) -> None:
        self.sums = sums
        self.total = total
        shift = max(0, total.bit_length() - LADDER.bit_length() + 1)
        self._hold(self._read(sums, shift))

    def _read(self, sums: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
        found = sums.groupBy(F.shiftright("stop", shift).alias("block")).agg(
            F.min("stop").alias("first"), F.max("stop").alias("last"), F.count_distinct("stop").alias("many")
        )
        return [(row.first, row.last, row.many, shift) for row in found.select("first", "last", "many").collect()]

    def _hold(self, spans: list[tuple[int, int, int, int]]) -> None:
        self.spans = sorted(spans)
        self.firsts = [span[0] for span in self.spans]
        self.doubtful: set[tuple[int, int, int, int]] = set()

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the largest prefix sum up to x, 0 if there is none. Notes the span if they differ."""
        n = bisect_right(self.firsts, x) - 1
        if n < 0:
            return 0, 0
        first, last, many, _ = self.spans[n]
        if x >= last:
            return last, last
        if many <= 2:
            return first, first
        self.doubtful.add(self.spans[n])
        return first, x

    def refine(self) -> None:
        """Read the noted spans in finer steps, LADDER steps in all."""
        noted = self.doubtful
        finer = (LADDER // len(noted)).bit_length() - 1
        fresh = []
        for shift in {span[3] for span in noted}:
            blocks = [span[0] >> shift for span in noted if span[3] == shift]
            fresh += self._read(self.sums.where(F.shiftright("stop", shift).isin(blocks)), max(0, shift - max(1, finer)))
        self._hold([span for span in self.spans if span not in noted] + fresh)


def _fill(ladder: Ladder, at: int, capacity: int, shards: int, bound: int) -> list[int]:
    """The cuts of a greedy filling from ``at``; bound 0 reads doubtful sums low, 1 high."""
    cuts = []
    for _ in range(shards):
        if at >= ladder.total:
            break
        step = ladder.below(at + capacity)[bound]
        if step <= at:
            break
        at = step
        cuts.append(at)
    return cuts


def _fits(ladder: Ladder, at: int, capacity: int, shards: int, bound: int = 0) -> bool:
    cuts = _fill(ladder, at, capacity, shards, bound)
    return (cuts[-1] if cuts else at) >= ladder.total


def _smallest(ladder: Ladder, shards: int, bound: int) -> int:
    low, high = -(-ladder.total // shards), ladder.total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _fits(ladder, 0, middle, shards, bound) else (middle + 1, high)
    return low


def _even(ladder: Ladder, capacity: int, shards: int) -> list[int]:
    """Cuts within the capacity, each as near as possible below an even share of what is left."""
    cuts: list[int] = []
    at = 0
    for left in range(shards, 0, -1):
        if at >= ladder.total:
            break
        step = ladder.below(at + min(capacity, -(-(ladder.total - at) // left)))[0]
        if step <= at or not _fits(ladder, step, capacity, left - 1):
            step = ladder.below(at + capacity)[0]
        at = step
        cuts.append(at)
    return cuts


def minimax_cuts(sums: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity over the prefix sums ``stop``, and the cuts: the last sum of each shard."""
    total = sums.agg(F.max("stop")).first()[0] or 0
    if not total:
        return 0, []
    ladder = Ladder(sums, total)
    while True:
        low, high = _smallest(ladder, shards, 1), _smallest(ladder, shards, 0)
        if low == high:
            break
        ladder.doubtful.clear()
        for capacity, bound in ((low, 0), (low, 1), (high, 0), (high, 1)):
            _fill(ladder, 0, capacity, shards, bound)
        _between(ladder, low, high, shards)
        ladder.refine()
    while True:
        ladder.doubtful.clear()
        cuts = _even(ladder, high, shards)
        if not ladder.doubtful:
            return high, cuts
        ladder.refine()


def _between(ladder: Ladder, low: int, high: int, shards: int) -> None:
    """Note all spans in which a cut may fall for a capacity from low to high."""
    early, late = _fill(ladder, 0, low, shards, 0), _fill(ladder, 0, high, shards, 1)
    at, other = 0, 0
    for n in range(shards):
        a, b = bisect_right(ladder.firsts, at + low) - 1, bisect_right(ladder.firsts, other + high) - 1
        ladder.doubtful.update(span for span in ladder.spans[max(0, a) : b + 1] if span[2] > 2)
        at, other = (early[n] if n < len(early) else at), (late[n] if n < len(late) else ladder.total)


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law is ``bytes``.

    Size is the UTF-8 bytes of the text plus 8. Null text counts as empty. Rows of equal text share a shard, so a text
    with more than an even share of all bytes fills one alone; the capacity is never larger than such a text needs.
    slot numbers the rows of a shard from 0 in the order of groups (smallest id first) and ids; null ids come last.
    Repeated rows take a slot each. With fewer groups than shards the last shards are empty; an empty table gives none.
    """
    many = parts(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("text_key"),
    )
    # Runs of ids split a group that holds a large part of all rows.
    rows = written(narrow, "sized").repartitionByRange(many, "doc_id").withColumn("run", F.spark_partition_id())
    rows = written(rows, "runs")
    runs = rows.groupBy("text_key", "run").agg(
        F.count("*").alias("many"), F.sum("size").alias("bytes"), F.min("doc_id").alias("least")
    )
    runs = written(runs, "counted")
    groups = runs.groupBy("text_key").agg(F.sum("many").alias("many"), F.sum("bytes").alias("bytes"), F.min("least").alias("least"))
    groups = groups.withColumn("place", F.coalesce("least", F.lit((1 << 63) - 1)))
    order = ["place", "text_key"]
    groups = written(groups.repartitionByRange(many, *order).withColumn("part", F.spark_partition_id()), "groups")

    totals = groups.groupBy("part").agg(F.sum("many").alias("all_rows"), F.sum("bytes").alias("all_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("all_rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("all_bytes").over(before), F.lit(0)).alias("bytes_before"),
    )
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumns({"row": F.sum("many").over(running), "stop": F.sum("bytes").over(running)})
    placed = placed.join(F.broadcast(offsets), "part").select(
        "text_key", (F.col("rows_before") + F.col("row") - F.col("many")).alias("row"), (F.col("bytes_before") + F.col("stop")).alias("stop")
    )
    placed = written(placed, "placed")

    _, cuts = minimax_cuts(placed.select("stop"), shards)
    shard = sum((F.when(F.col("stop") > cut, 1).otherwise(0) for cut in cuts[:-1]), F.lit(0)).cast("int")
    placed = placed.select("text_key", "row", shard.alias("shard"))
    begins = placed.groupBy("shard").agg(F.min("row").alias("begin"))  # at most one row per shard
    placed = placed.join(F.broadcast(begins), "shard").select("text_key", "shard", (F.col("row") - F.col("begin")).alias("row"))

    earlier = Window.partitionBy("text_key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row per run
    runs = runs.select("text_key", "run", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("earlier"))
    runs = runs.join(placed, "text_key").select("text_key", "run", "shard", (F.col("row") + F.col("earlier")).alias("row"))
    within = Window.partitionBy("text_key", "run").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(runs, ["text_key", "run"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
