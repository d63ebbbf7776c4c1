"""Exact duplicates by recipes of content-defined chunks.

A normalised text is cut where a hash over its last 16 bytes has a certain form, so equal passages are cut alike wherever
they lie. A document becomes its recipe: the ordered identifiers of its chunks. Chunks are deduplicated within each
task first and meet by hash once, whole, so that equal hashes are verified by bytes: a hash that names one content only
is the identifier itself, otherwise the contents are numbered apart. From then on only recipes travel; texts are equal
when their recipes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thornwall.llm.common import looked_up, numbered, task_name, text_bytes, written

#: Bytes of a chunk: at least, on average beyond that (a power of two), at most.
LEAST, SPREAD, MOST = 1024, 4096, 16384
#: Bytes of chunks that a task remembers to send each once.
HELD = 1 << 25


def _gears() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


GEARS = _gears()


def chunks(text: bytes) -> list[bytes]:
    """The chunks of a text in order; where it is cut depends on the bytes near the cut alone. Empty text has none."""
    if len(text) <= LEAST:
        return [text] if text else []
    mixed = GEARS[np.frombuffer(text, np.uint8)]
    for reach in (1, 2, 4, 8):  # sums over the last 2, 4, 8, 16 bytes
        moved = mixed[:-reach] << np.uint32(reach)
        mixed[reach:] += moved
    ends = np.flatnonzero(mixed < np.uint32((1 << 32) // SPREAD)) + 1
    found, begin = [], 0
    for end in [*ends.tolist(), len(text)]:
        while end - begin > MOST:
            found.append(text[begin : begin + MOST])
            begin += MOST
        if end - begin >= LEAST or end == len(text) > begin:
            found.append(text[begin:end])
            begin = end
    return found


def _digest(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def _recipes(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, uid, recipe, text_sha256) of (doc_id, text): uid names the row, the recipe has ``size`` bytes a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = task_name()[0] << 40
        for batch in batches:
            texts = [text.lower() for text in text_bytes(batch.column(1))]  # of bytes: A-Z only
            recipes = [b"".join(_digest(c, size) for c in chunks(text)) for text in texts]
            hashes = [hashlib.sha256(text).hexdigest() for text in texts]
            arrays = [batch.column(0), pa.array(range(uid, uid + len(texts)), pa.int64()), pa.array(recipes, pa.binary()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "uid", "recipe", "text_sha256"])
            uid += len(texts)

    return rows.mapInArrow(run, "doc_id long, uid long, recipe binary, text_sha256 string")


def _distinct_chunks(rows: DataFrame, size: int) -> DataFrame:
    """(digest, chunk) of every different chunk of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = 0
        for batch in batches:
            new = []
            for text in text_bytes(batch.column(0)):
                for chunk in chunks(text.lower()):
                    if chunk not in seen:
                        seen.add(chunk)
                        new.append(chunk)
                        held += len(chunk)
                    if held > HELD:
                        yield out(new, size)
                        seen, new, held = set(), [], 0
            yield out(new, size)

    def out(found: list[bytes], size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_digest(c, size) for c in found], pa.binary()), pa.array(found, pa.binary())], names=["digest", "chunk"])

    sent = rows.select("text").mapInArrow(run, "digest binary, chunk binary")
    return sent.dropDuplicates(["digest", "chunk"])


def _exact_recipes(rows: DataFrame, recipes: DataFrame, size: int) -> DataFrame:
    """``recipes`` whose identifiers also number the contents of a hash; ``rows`` has (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                found = chunks(text.lower())
                arrays = [pa.array([uid] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64())]
                arrays += [pa.array([_digest(c, size) for c in found], pa.binary()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", "place", "digest", "chunk"])

    used = rows.select("uid", "text").mapInArrow(run, "uid long, place long, digest binary, chunk binary")
    contents = used.select("digest", "chunk").distinct()
    contents = contents.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")))
    named = used.join(contents, ["digest", "chunk"]).select("uid", F.struct("place", "digest", "variant").alias("part"))
    listed = named.groupBy("uid").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    name = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", F.hex(p["digest"]), p["variant"])), ",")
    exact = listed.select("uid", name.cast("binary").alias("exact"))
    joined = recipes.join(exact, "uid", "left")
    return joined.select("doc_id", "uid", F.coalesce("exact", F.lit(b"")).alias("recipe"), "text_sha256")


def verified_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 16) -> DataFrame:
    """(doc_id, uid, recipe, text_sha256) of every row; rows have equal recipes exactly when their texts are equal.

    ``size`` is the length of a chunk's hash in bytes, 16 at most. Null text is empty text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    recipes = written(_recipes(rows, size), "recipes")
    shared = written(_distinct_chunks(rows, size).groupBy("digest").count().where("count > 1"), "shared")
    if shared.isEmpty():
        return recipes
    # A hash with several contents: the rows are named anew and stored, so that names hold while chunks are numbered.
    stored = written(rows.withColumn("uid", F.monotonically_increasing_id()), "stored")
    again = _recipes(stored.select("uid", "text").toDF("doc_id", "text"), size)
    again = again.select(F.col("doc_id").alias("uid"), "recipe", "text_sha256").join(stored.select("uid", "doc_id"), "uid")
    return written(_exact_recipes(stored, again, size), "exact")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and all empty texts are equal.
    Of equal texts one row stays, that with the largest id; of rows repeated with that id one, and where all ids of a
    group are null one of them (its keep_id is null). group_size counts rows. An empty table gives no rows. Other
    columns are not read.
    """
    recipes = verified_recipes(docs, id_col, text_col, size)
    last = F.coalesce(F.max_by("uid", "doc_id"), F.max("uid")).alias("keep_uid")
    groups = written(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), last, F.count("*").alias("many")), "groups")
    found = looked_up(recipes, groups.where("many > 1"), "recipe", "uid")
    return found.select(
        "doc_id",
        F.when(F.col("many").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("many", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("keep_uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Rows are numbered and stored, decided by number, and their texts moved once more at most.
    """
    stored, name = numbered(docs)
    order = F.struct(F.col(id_col).cast("long").alias("id"), F.col(name).alias("row"))
    ranked = stored.select(order.alias("order"), F.col(text_col).alias("text"))
    recipes = verified_recipes(ranked.select(F.col("order.row").alias("doc_id"), "text"))
    ids = stored.select(F.col(name).alias("doc_id"), F.col(id_col).cast("long").alias("id"))
    rows = recipes.select("doc_id", "recipe").join(ids, "doc_id")
    keep = rows.groupBy("recipe").agg(F.coalesce(F.max_by("doc_id", "id"), F.max("doc_id")).alias(name))
    return stored.join(keep.select(name), name, "left_semi").select(*docs.columns)
