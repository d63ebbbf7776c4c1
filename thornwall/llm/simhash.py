"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints are grouped, sorted by population count and cut into tiles. Two tiles are compared when their
population counts lie within the radius of each other; inside a pair of tiles, blocks are compared by numpy
exclusive-or and bit counts unless the counts of their 16-bit parts already differ by more than the radius. A pair
of tiles returns a star per set of linked fingerprints instead of all linked pairs, so a large group of near copies
costs rows in proportion to its size. The comparison stays quadratic in the number of different fingerprints, with
tiles of at most ``MAX_TILE`` rows; which tiles meet is worked out in Spark as well. Fingerprints are the nodes of the
links, so two texts under one id are two nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thornwall.llm.common import components, looked_up, numbered, parts, text_bytes, written

#: Rows of a tile: a sixteenth of the fingerprints within these bounds.
MIN_TILE, MAX_TILE = 8192, 1 << 21
#: Shingles whose bits are counted at once, and rows and columns of a compared block.
STEP, ROWS, COLUMNS = 1 << 16, 256, 8192
BITS = 64


def shingles(text: bytes, words: int) -> list[bytes]:
    """The word shingles of a text, A-Z lower-cased, repeats included, single spaces between words.

    Fewer words give the whole sequence as one shingle, none gives no shingle.
    """
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-1].tolist()]
    return [joined[i:j] for i, j in zip(starts, (ends[min(words, len(found)) - 1 :] - 1).tolist())]


def fingerprint(text: bytes, words: int) -> bytes:
    """Bit by bit the strict majority over the XXH64 hashes (seed 42) of all shingles; zero without shingles, ties give 0."""
    found = shingles(text, words)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(found), STEP):
        digests = [xxhash.xxh64_digest(s, 42) for s in found[at : at + STEP]]
        rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint long) of every row; equal texts in one batch are computed once. Null text is empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            out = []
            for text in text_bytes(batch.column(1)):
                if text not in seen:
                    seen[text] = int.from_bytes(fingerprint(text, words), "big", signed=True)
                out.append(seen[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint long")


def _tiles(distinct: DataFrame) -> DataFrame:
    """One row per tile of the column fingerprint: (tile, low, high, prints binary), sorted by population counts."""
    spark = distinct.sparkSession
    total = distinct.count()
    tile = min(MAX_TILE, max(MIN_TILE, -(-total // 16)))
    pieces = [F.bit_count(F.shiftright("fingerprint", 16 * n).bitwiseAND(F.lit(0xFFFF).cast("long"))) for n in (3, 2, 1)]
    keys = [F.bit_count("fingerprint").alias("ones"), *[piece.alias(f"p{n}") for n, piece in enumerate(pieces)]]
    counted = distinct.select("fingerprint", *keys)
    many = max(1, min(parts(spark), -(-total // tile)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 20
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            nonlocal base
            row = [base, table["ones"][0].as_py(), table["ones"][-1].as_py(), table["fingerprint"].to_numpy().astype("<i8").tobytes()]
            base += 1
            return pa.RecordBatch.from_pylist([dict(zip(shape.names, row, strict=True))], schema=shape)

        shape = pa.schema([("tile", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("prints", pa.binary())])
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= tile:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, tile))
                held = table.slice(tile).combine_chunks().to_batches()
                rows -= tile
        if rows:
            yield out(pa.Table.from_batches(held))

    counted = counted.repartitionByRange(many, "ones", "p0", "p1", "p2", "fingerprint")
    sorted_rows = counted.sortWithinPartitions("ones", "p0", "p1", "p2")
    return written(sorted_rows.mapInArrow(run, "tile long, low int, high int, prints binary"), "tiles")


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; roots are the smallest positions."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent[:] = up


def compare(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all rows [n, 1] of uint64 within the radius, sorted by population counts."""

    def boxes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones = np.bitwise_count(np.ascontiguousarray(rows).view(np.uint16).reshape(len(rows), -1)).astype(np.int16)
        ones = np.concatenate([ones, ones.sum(1, keepdims=True)], axis=1)
        cuts = np.arange(0, len(rows), ROWS)
        return np.minimum.reduceat(ones, cuts), np.maximum.reduceat(ones, cuts)

    (low, high), (other_low, other_high) = boxes(left), boxes(right)
    for k in range(len(low)):
        gap = np.maximum(0, np.maximum(other_low - high[k], low[k] - other_high))
        near = np.flatnonzero((gap[:, :-1].sum(1) <= radius) & (gap[:, -1] <= radius))
        if not len(near):
            continue
        columns = (near[:, None] * ROWS + np.arange(ROWS)).ravel()
        columns = columns[columns < len(right)]
        rows = left[k * ROWS : (k + 1) * ROWS]
        for at in range(0, len(columns), COLUMNS):
            chosen = columns[at : at + COLUMNS]
            i, j = np.nonzero(np.bitwise_count(rows ^ right[chosen, 0]) <= radius)
            if len(i):
                yield i + k * ROWS, chosen[j]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) between different values of the column fingerprint that differ in at most ``radius`` bits.

    They come as stars, one per set that the links of a pair of tiles connect: what is connected is as with all links.
    """
    tiles = _tiles(distinct)
    # Tiles in their order; each meets itself and the later ones whose counts lie within the radius. One narrow row a pair.
    named = tiles.select("tile", "low", "high", (F.row_number().over(Window.orderBy("tile")) - 1).alias("no"))
    last = F.max("no").over(Window.partitionBy())
    reach = named.withColumn("last", last).select("tile", "high", "no", F.explode(F.sequence("no", "last")).alias("other"))
    later = named.select(F.col("no").alias("other"), F.col("tile").alias("second"), F.col("low").alias("begin"))
    pairs = reach.join(later, "other").where(F.col("begin") - F.col("high") <= radius)
    pair = F.concat_ws("-", "tile", "second").alias("pair")
    sides = pairs.select(pair, F.explode(F.array(F.struct("tile", F.lit(0).alias("side")), F.struct(F.col("second").alias("tile"), F.lit(1).alias("side")))).alias("s"))
    sides = written(sides.select("pair", "s.tile", "s.side"), "pairs")

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["side"].to_numpy())  # a tile that meets itself comes as two equal rows
        values = [np.frombuffer(group["prints"][int(n)].as_py(), "<i8") for n in order]
        known = np.unique(np.concatenate(values))
        places = [np.searchsorted(known, x) for x in values]
        parent = np.arange(len(known))
        for i, j in compare(*[x.astype(np.uint64)[:, None] for x in values], radius):
            _merge(parent, places[0][i], places[1][j])
        star = np.flatnonzero(parent != np.arange(len(known)))
        return pa.table({"a": known[star], "b": known[parent[star]]})

    many = max(1, min(sides.count() // 2, 4 * parts(distinct.sparkSession)))
    dealt = sides.join(tiles.select("tile", "prints"), "tile").repartition(many, "pair")
    return written(dealt.groupBy("pair").applyInArrow(run, "a long, b long"), "links")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, root) of the fingerprints that rows with an id have; root is one of the class."""
    distinct = written(prints.where("id is not null").select("fingerprint").distinct(), "distinct")
    roots = components(links(distinct, radius)).toDF("fingerprint", "root")
    return distinct.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """Every row with its fingerprint and class: (doc_id, fingerprint hex string, component_id).

    Rows link when their fingerprints differ in at most ``radius`` bits; component_id is the smallest id reachable.
    Null and empty texts have fingerprint zero and link like any other. Repeated rows and ids are kept. A row with a
    null id keeps its fingerprint, links nothing and has a null component. An empty table gives no rows. Other columns are
    not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "prints")
    groups = prints.where("id is not null").groupBy("fingerprint").agg(F.min("id").alias("low"), F.count("*").alias("many"))
    groups = written(groups.join(_classes(prints, radius), "fingerprint"), "groups")
    roots = groups.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("many"))
    named = looked_up(groups.select("fingerprint", "root", F.col("many").alias("rows")), roots, "root", "fingerprint")
    named = named.select("fingerprint", "component_id", F.col("rows").alias("many"))
    found = looked_up(prints.withColumn("spread", F.coalesce("id", F.lit(0))), written(named, "named"), "fingerprint", "spread")
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class of ``near_duplicates`` the row with the smallest id stays.

    Decisions are made row by row: of repeated rows one stays, and texts of one id that are no near copies of each other are
    decided apart. Rows with a null id link nothing and stay. All texts without words form one class. An empty table gives
    an empty one. All columns are kept as they are, whatever their names.
    """
    stored, row = numbered(docs)
    marked = stored.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = written(fingerprints(marked, "row", "text", words).withColumnRenamed("id", "row"), "prints")
    prints = prints.join(marked.where("id is not null").select("row", "id"), "row")
    groups = prints.groupBy("fingerprint").agg(F.min(F.struct("id", "row")).alias("first"))
    groups = written(groups, "groups")
    classes = _classes(groups.select(F.col("first.id").alias("id"), "fingerprint"), radius)
    keep = groups.join(classes, "fingerprint").groupBy("root").agg(F.min("first").alias("first"))
    keep = keep.select(F.col("first.row").alias(row)).unionByName(marked.where("id is null").select(F.col("row").alias(row)))
    return stored.join(keep, row, "left_semi").select(*docs.columns)
