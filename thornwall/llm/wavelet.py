"""Token ids on disk as wavelet matrices, one compressed file per shard.

A file holds the documents of a range of ids: their ids and lengths, and one bit-plane per bit of the token ids. Planes
are cut into blocks, each compressed on its own with the number of ones before it, so a reader finds one token, counts
a token up to a place or finds its k-th occurrence by reading a few blocks of each plane. Blocks that do not shrink are
stored as they are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thornwall.config import shared_folder
from thornwall.llm.common import file_system, parts, task_name, written
from thornwall.llm.tokens import encoder

MAGIC = b"TWWM0003"
#: Bytes of a block of a bit-plane, and tokens of a file at most.
BLOCK, FILE_TOKENS = 4096, 1 << 22
TRIED = 16


def encode_file(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The bytes of one file. ``known`` is 0 where the document id is null.

    Layout: magic; tokens, documents, planes (3 x u64); the compressed document table with its length; then for each
    plane from the highest bit: zeros, blocks (2 x u64), per block the ones before it and its end (u64), the blocks. A block
    as long as its bits is plain, a shorter one compressed. Planes are tried on every ``TRIED``-th block first.
    """
    planes = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    table = zlib.compress(doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + lengths.astype("<u4").tobytes(), 1)
    out = [MAGIC, struct.pack("<4Q", len(tokens), len(doc_ids), planes, len(table)), table]
    rest = tokens.astype(np.uint16 if planes <= 16 else np.uint32)
    shrink = zstandard.ZstdCompressor(level=1).compress
    for level in range(planes - 1, -1, -1):
        bits = (rest & rest.dtype.type(1 << level)) != 0
        packed = np.packbits(bits)
        blocks = [packed[i : i + BLOCK].tobytes() for i in range(0, len(packed), BLOCK)]
        counted = np.zeros(len(blocks) * BLOCK, np.uint8)
        counted[: len(packed)] = packed
        counts = np.bitwise_count(counted).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        ones = np.cumsum(counts) - counts
        shrinks = any(len(shrink(b)) < 0.95 * len(b) for b in blocks[::TRIED])
        small = [min(b, shrink(b), key=len) for b in blocks] if shrinks else blocks  # plain where equally long
        ends = np.cumsum([len(b) for b in small])
        out.append(struct.pack("<2Q", len(rest) - int(bits.sum()), len(blocks)))
        out += [ones.astype("<u8").tobytes(), ends.astype("<u8").tobytes(), *small]
        rest = np.concatenate([np.compress(~bits, rest), np.compress(bits, rest)])
    return b"".join(out)


class WaveletFile:
    """A reader over the bytes of a file; blocks are unpacked when a question needs them."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        self.data = data
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.size, docs, planes, table = struct.unpack_from("<4Q", data, 8)
        raw = zlib.decompress(data[40 : 40 + table])
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.known = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool)
        self.lengths = np.frombuffer(raw, "<u4", docs, 9 * docs).astype(np.int64)
        at = 40 + table
        self.planes: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for _ in range(planes):
            zeros, blocks = struct.unpack_from("<2Q", data, at)
            ones = np.frombuffer(data, "<u8", blocks, at + 16).astype(np.int64)
            ends = np.frombuffer(data, "<u8", blocks, at + 16 + 8 * blocks).astype(np.int64)
            begin = at + 16 + 16 * blocks
            self.planes.append((zeros, ones, ends, begin))
            at = begin + (int(ends[-1]) if blocks else 0)

    def _block(self, plane: int, block: int) -> np.ndarray:
        _, _, ends, begin = self.planes[plane]
        first, last = begin + (int(ends[block - 1]) if block else 0), begin + int(ends[block])
        size = min(BLOCK, (self.size + 7) // 8 - block * BLOCK)
        return np.frombuffer(self.data[first:last] if last - first == size else self.unpack(self.data[first:last]), np.uint8)

    def _rank(self, plane: int, place: int) -> int:
        """Ones of a plane before a place."""
        _, ones, _, _ = self.planes[plane]
        block, within = divmod(place, 8 * BLOCK)
        if block >= len(ones):
            block, within = len(ones) - 1, within + 8 * BLOCK
        if block < 0:
            return 0
        return int(ones[block]) + int(np.unpackbits(self._block(plane, block))[:within].sum())

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        _, ones, _, _ = self.planes[plane]
        before = ones if bit else np.arange(len(ones)) * 8 * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        places = np.flatnonzero(np.unpackbits(self._block(plane, block)) == bit)
        return block * 8 * BLOCK + int(places[k - int(before[block])])

    def access(self, place: int) -> int:
        """The token at a place."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        token = 0
        for plane, (zeros, _, _, _) in enumerate(self.planes):
            ones = self._rank(plane, place)
            bit = self._rank(plane, place + 1) - ones
            token = token << 1 | bit
            place = zeros + ones if bit else place - ones
        return token

    def _range(self, token: int, place: int) -> tuple[int, int]:
        """Where the occurrences of a token before a place lie in the last order."""
        first, last = 0, min(max(place, 0), self.size)
        if token >> len(self.planes):
            return 0, 0
        for plane, (zeros, _, _, _) in enumerate(self.planes):
            a, b = self._rank(plane, first), self._rank(plane, last)
            one = token >> (len(self.planes) - 1 - plane) & 1
            first, last = (zeros + a, zeros + b) if one else (first - a, last - b)
        return first, last

    def count(self, token: int, place: int | None = None) -> int:
        """How often a token occurs before a place (in the whole file without one)."""
        first, last = self._range(token, self.size if place is None else place)
        return last - first

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of a token, -1 if there are fewer."""
        first, last = self._range(token, self.size)
        if not 0 <= k < last - first:
            return -1
        place = first + k
        for plane in range(len(self.planes) - 1, -1, -1):
            zeros = self.planes[plane][0]
            one = token >> (len(self.planes) - 1 - plane) & 1
            place = self._select(plane, one, place - zeros if one else place)
        return place

    def tokens(self) -> np.ndarray:
        """All tokens in their order."""
        values = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for plane in range(len(self.planes) - 1, -1, -1):
            zeros, ones, _, _ = self.planes[plane]
            packed = [self._block(plane, n) for n in range(len(ones))]
            bits = np.unpackbits(np.concatenate(packed or [np.zeros(0, np.uint8)]))[: self.size].view(bool)
            upper = np.empty_like(values)
            upper[np.flatnonzero(~bits)] = values[:zeros]
            upper[np.flatnonzero(bits)] = values[zeros:] | (1 << (len(self.planes) - 1 - plane))
            values = upper
        return values


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents in ascending order of id; returns the manifest (part, piece, path, documents, tokens).

    Tasks write under names of their own attempt, and only the files of the manifest count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        part, attempt = task_name()
        encode = encoder(tokenizer).encode
        end = end_id.to_bytes(4, "little")
        held: list[tuple[int | None, bytes]] = []
        piece = size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(ids) // 4 for _, ids in held], np.int64)
            tokens = np.frombuffer(b"".join(ids for _, ids in held), "<u4")
            known = np.array([doc is not None for doc, _ in held], bool)
            data = encode_file(np.array([doc or 0 for doc, _ in held], np.int64), known, lengths, tokens)
            path = f"{base}/shard-{part:06d}-{piece:04d}-{attempt}.twm"
            with system.open_output_stream(path, compression=None) as out:
                out.write(data)
            values = {"part": part, "piece": piece, "path": f"{folder}/{path.rsplit('/', 1)[1]}", "documents": len(held), "tokens": len(tokens)}
            return pa.RecordBatch.from_pylist([values])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= FILE_TOKENS:
                    yield flush()
                    held, size, piece = [], 0, piece + 1
        if held:
            yield flush()

    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = narrow.repartitionByRange(parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(run, "part long, piece long, path string, documents long, tokens long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    earlier = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = file_system(path)
                with system.open_input_file(place) as source:
                    file = WaveletFile(source.read())
                data = memoryview(file.tokens().astype("<u4").tobytes())
                stops = np.cumsum(file.lengths)
                starts = stops - file.lengths
                sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
                columns = [pa.array(file.doc_ids, mask=~file.known), pa.array(starts + begin), pa.array(file.lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = files.repartition(parts(manifest.sparkSession), "path")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents and read them back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts have the end id alone. Null ids come first, rows with one id in the order of their texts. An
    empty table writes no file and gives no rows.
    """
    folder = shared_folder(docs.sparkSession)
    return read_files(write_files(docs, folder, tokenizer, end_id, id_col, text_col))
