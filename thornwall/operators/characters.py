"""Character distribution and entropy of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from thornwall.functions.slices import slices

#: Texts of so many characters are counted where they lie, each of their different characters by one replacement.
PIECE = 4096


def _counted(piece: Column) -> Column:
    """(character, n) of each different character of a text."""
    length = F.char_length(piece)
    return F.transform(
        F.array_distinct(F.split(piece, "")),
        lambda c: F.struct(c.alias("character"), (length - F.char_length(F.replace(piece, c, F.lit("")))).cast("long").alias("n")),
    )


def _groups(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each group, group of each row) of rows with the same keys."""
    group = np.zeros(rows, np.int64)
    for column in columns:
        try:
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        except pa.ArrowNotImplementedError:  # keys of nested types: each row counts alone here
            code = np.arange(rows)
        group = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    return np.unique(group, return_index=True)[1], group


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code point, n) of each different character of some texts."""
    codes = np.frombuffer(b"".join(texts).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(codes) and codes.max() > (1 << 16) + 4 * len(codes):
        return np.unique(codes, return_counts=True)
    counts = np.bincount(codes)
    found = np.flatnonzero(counts)
    return found, counts[found]


def character_counts(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(*keys, character, n): how often each character occurs in the texts of each group; null texts have none.

    Tasks count in slices of their rows; a row per slice, group and different character leaves them, and they add these up
    before they meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, many in slices(batch.column(len(keys))):
                part = batch.slice(first, many)
                firsts, group = _groups(part.columns[:-1], many)
                texts: list[list[bytes]] = [[] for _ in firsts]
                for g, t in zip(group.tolist(), part.column(len(keys)).cast(pa.binary()).to_pylist()):
                    if t:
                        texts[g].append(t)
                found = [_codes(t) for t in texts]
                places = pa.array(np.repeat(firsts, [len(c) for c, _ in found]))
                characters = pa.array([chr(c) for codes, _ in found for c in codes.tolist()], pa.string())
                counts = pa.array(np.concatenate([n for _, n in found]).astype(np.int64))
                columns = [*(column.take(places) for column in part.columns[:-1]), characters, counts]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = df.select(*keys, F.col(text).cast("string").alias("text"))
    schema = StructType([*narrow.schema.fields[:-1], StructField("character", StringType()), StructField("n", LongType())])
    names = schema.names
    return narrow.mapInArrow(run, schema).groupBy(*keys, "character").agg(F.sum("n").alias("n"))


def _bits(total: Column, weighted: Column) -> Column:
    """Entropy from the number of characters and the sum of n * log2(n), 0 for no text."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total) - weighted / total)).otherwise(F.lit(0.0))


def group_entropy(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(*keys, n_chars, n_distinct, entropy): the texts of each group as one; entropy in bits per character.

    Groups without a character have no row.
    """
    counts = character_counts(df, text, *keys)
    totals = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_chars"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") * F.log2("n")).alias("weighted")
    )
    return totals.select(*keys, "n_chars", "n_distinct", _bits(F.col("n_chars"), F.col("weighted")).alias("entropy"))


def text_entropy(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(*keys, n_chars, n_distinct, entropy) of each text; null and empty texts have 0 of all.

    ``keys`` name a row. Texts of up to PIECE characters are counted where they lie and need no shuffle; the counts of
    longer ones meet by key and character. Both read the table once.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    short = df.where(F.char_length(value) <= PIECE).select(*keys, F.char_length(value).cast("long").alias("n_chars"), _counted(value).alias("found"))
    empty = F.col("n_chars") == 0
    weighted = F.aggregate("found", F.lit(0.0), lambda total, c: total + c["n"] * F.log2(c["n"].cast("double")))
    here = short.select(
        *keys,
        "n_chars",
        F.when(empty, 0).otherwise(F.size("found")).cast("long").alias("n_distinct"),
        F.when(empty, 0.0).otherwise(_bits(F.col("n_chars"), weighted)).alias("entropy"),
    )
    return here.unionByName(group_entropy(df.where(F.char_length(text) > PIECE), text, *keys))
