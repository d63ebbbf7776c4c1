"""Line deduplication: a repeated line stays in the document with the smallest id only.

Every line becomes a narrow row (128-bit hash of its key, document, position). The rows are range-partitioned by all
of these columns and sorted, so a line that a third of all documents hold is spread over many partitions. Each
partition streams its rows and sees the first occurrence of each hash; the hash that a partition begins with may have
begun in an earlier one, so its rows stay undecided until the first and last hashes of all partitions (two rows each)
are known. The result is one compressed keep bitmap per document with dropped lines, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thornwall.llm.common import free_name, parts, text_bytes, written

#: Fixed: white space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text): version tells rows of one id with different texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (h1, h2, id, version, pos) to dropped rows (kind 0), undecided rows (1) and border hashes (2)."""
    begin: tuple[int, int] | None = None  # the hash the partition begins with
    begin_owner = 0
    last: tuple[int, int] | None = None
    owner = 0

    def out(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "h1", "h2", "id", "version", "pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, version, pos = (column.to_numpy() for column in batch.columns)
        new = np.r_[last != (int(h1[0]), int(h2[0])), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(new)
        group = np.cumsum(new)
        owners = np.concatenate([[owner], ids[starts]])[group]
        if begin is None:
            begin, begin_owner = (int(h1[0]), int(h2[0])), int(ids[0])
        undecided = (h1 == begin[0]) & (h2 == begin[1])
        dropped = (ids != owners) & ~undecided
        for kind, mask in ((0, dropped), (1, undecided)):
            if mask.any():
                yield out(kind, [x[mask] for x in (h1, h2, ids, version, pos)])
        last, owner = (int(h1[-1]), int(h2[-1])), int(owners[-1])
    if begin is not None:
        ends = np.array([[*begin, begin_owner], [*last, owner]], np.int64)
        zero = np.zeros(2, np.int64)
        yield out(2, [ends[:, 0], ends[:, 1], ends[:, 2], zero, zero.astype(np.int32)])


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, version, pos) of every line that goes. Rows with a null id take no part."""
    rows = _rows(docs, id_col, text_col).where("id is not null")
    lines = rows.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "version", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.char_length("key") >= min_chars)
    order = ["h1", "h2", "id", "version", "pos"]
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "version", "pos")
    hashed = written(hashed, "lines")
    dealt = hashed.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    seen = written(dealt.mapInArrow(_first_seen, "kind int, h1 long, h2 long, id long, version long, pos int"), "seen")
    # At most two rows per partition, so the lookup is bounded by their number.
    owners = seen.where("kind = 2").groupBy("h1", "h2").agg(F.min("id").alias("owner"))
    late = seen.where("kind = 1").join(F.broadcast(owners), ["h1", "h2"]).where("id <> owner")
    return seen.where("kind = 0").select("id", "version", "pos").unionByName(late.select("id", "version", "pos"))


@F.pandas_udf(T.BinaryType())
def _bitmap(positions):
    """The keep bitmap up to the last dropped line, compressed; later lines stay."""

    def pack(pos) -> bytes:
        keep = np.ones((int(max(pos)) // 8 + 1) * 8, bool)
        keep[np.asarray(pos)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return positions.map(pack)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, version, keep): a compressed bitmap of each document that loses lines, line 0 in the highest bit."""
    dropped = dropped_lines(docs, id_col, text_col, min_chars)
    return dropped.groupBy("id", "version").agg(F.collect_list("pos").alias("pos")).select("id", "version", _bitmap("pos").alias("keep"))


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text that stays, its lines before, and how many went."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    flags = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    flags += [1] * (len(lines) - len(flags))
    kept = [line for line, flag in zip(lines, flags, strict=True) if flag]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, str]:
    """``docs`` with the bitmap of each row (null: all lines stay), and the name of that column, which none of them has."""
    names = [free_name(docs, name) for name in ("line_id", "line_version", "line_keep")]
    maps = keep_bitmaps(docs, id_col, text_col, min_chars).toDF(*names)
    version = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = docs.join(maps, (F.col(id_col).cast("long") == F.col(names[0])) & (version == F.col(names[1])), "left")
    return joined.drop(*names[:2]), names[2]


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row.

    Null or empty text is one empty line. Rows with a null id keep their lines and are no one's first. Rows of one id
    count as one document. All lines of a document may go; it then keeps the empty text.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [kept_lines(*pair) for pair in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            hashes = [hashlib.sha256(kept).hexdigest() for kept, _, _ in out]
            counts = [pa.array([row[k] for row in out], pa.int64()) for k in (1, 2)]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(hashes, pa.string())], names=names)

    joined, keep = _with_bitmaps(narrow, "doc_id", "text", min_chars)
    joined = joined.select("doc_id", "text", keep)
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


@F.pandas_udf(T.StringType())
def _apply(texts, keeps):
    pairs = zip(texts, keeps, strict=True)
    kept = [text if keep is None else kept_lines(text.encode(), keep)[0].decode() for text, keep in pairs]
    return texts.__class__(kept, dtype=object)


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with the repeated lines of its texts dropped; all other columns and all rows stay.

    A null text stays null. Rows with a null id keep their lines. Rows of one id count as one document, so repeated rows
    lose no lines to each other. A document may lose all its lines and keep the empty text. An empty table stays empty.
    """
    joined, keep = _with_bitmaps(docs, id_col, text_col, min_chars)
    kept = F.when(F.col(keep).isNull(), F.col(text_col)).otherwise(_apply(F.col(text_col), F.col(keep)))
    return joined.withColumn(text_col, kept).select(*docs.columns)
