"""Benchmark decontamination by SimHash windows of the size of the items; a shorter document is one window.

Every window of as many words as an item has gets the SimHash of its shingles. A multi-index over blocks of the items'
fingerprints finds all items within the radius: where the limits of the blocks, each plus one, sum to more than the radius,
two fingerprints within it agree up to the limit in some block. Fingerprints have 256 bits in 8 blocks, since that keeps the
distances of similar and of other texts apart: at the default radius some 3 % of random pairs pass a block. Candidates within
the radius are verified by the exact weighted similarity of their shingles.
A window that shares no shingle with any item has similarity zero and needs no fingerprint, so only windows around
shared shingles get one; this leaves out nothing that verification would keep.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwall.llm.common import free_name, text_bytes, written

#: Words are lower-cased (A-Z) and end at white space and at ASCII punctuation.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256)
)
BLOCKS, BITS = 8, 256
#: Words of benchmark items in one pass over the documents, words of a document looked at together, and pairs of block
#: values compared and windows of all lengths looked up at once.
PASS_WORDS, STRETCH, COMPARED, WINDOWS = 300_000, 4096, 1 << 21, 1 << 16


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def limits(radius: int) -> list[int]:
    """The bits that each block may differ in, so that no pair of fingerprints within ``radius`` is missed."""
    return [(radius + 1 + block) // BLOCKS - 1 for block in range(BLOCKS)]


def _bits(shingles: list[bytes]) -> np.ndarray:
    """[shingles, BITS]: a hash of each shingle and three more mixed from it."""
    first = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), ">u8").astype(np.uint64)
    mixed = first[:, None] + np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return np.unpackbits(mixed.view(np.uint8).reshape(len(shingles), -1), axis=1)


def _prints(sums: np.ndarray, many: int) -> np.ndarray:
    """[rows, BLOCKS] of fingerprints: the bits set in over half of ``many`` shingles."""
    return np.packbits(sums * 2 > many, axis=-1).reshape(-1, BITS // 8).view(np.uint32)


class Blocks:
    """Fingerprints of several kinds by the values of their blocks: the distinct values, and the rows that have them."""

    def __init__(self, prints: np.ndarray, kinds: np.ndarray) -> None:
        self.prints = prints
        slots = kinds[:, None].astype(np.int64) * BLOCKS + np.arange(BLOCKS)
        keys = (prints + (slots << 32)).ravel()
        order = np.argsort(keys)
        held = keys[order]
        first = np.ones(len(held), bool)
        first[1:] = held[1:] != held[:-1]
        self.rows, self.begin, self.values = order // BLOCKS, np.flatnonzero(first), held[first]
        self.many = np.diff(self.begin, append=len(held))
        slot = self.values >> 32
        at = np.flatnonzero(np.diff(slot, prepend=-1))
        #: where the values of each kind and block begin and end
        self.slots = dict(zip(slot[at].tolist(), zip(at.tolist(), [*at[1:].tolist(), len(slot)], strict=True), strict=True))

    def within(self, radius: int, other: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """(row, row of ``other``) of all pairs of one kind whose fingerprints differ in at most ``radius`` bits."""
        left, right = [], []
        allowed = limits(radius)
        for slot, (at, end) in self.slots.items():
            low, high = other.slots.get(slot, (0, 0))
            step = max(1, COMPARED // max(1, high - low))
            for start in range(at, end if high else at, step):
                mine = self.values[start : min(end, start + step), None]
                v, h = (np.bitwise_count(mine ^ other.values[low:high]) <= allowed[slot % BLOCKS]).nonzero()
                left.append(v + start)
                right.append(h + low)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        v, h = np.concatenate(left), np.concatenate(right)
        # Each pair of near values stands for all pairs of rows that have them.
        sizes = self.many[v] * other.many[h]
        pair = np.repeat(np.arange(len(v)), sizes)
        n = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        v, h = v[pair], h[pair]
        rows, which = self.rows[self.begin[v] + n // other.many[h]], other.rows[other.begin[h] + n % other.many[h]]
        near = np.bitwise_count(self.prints[rows] ^ other.prints[which]).sum(1) <= radius
        pairs = np.unique(rows[near] * len(other.prints) + which[near])
        return pairs // len(other.prints), pairs % len(other.prints)


@dataclass
class Items:
    """The benchmark items of one pass, indexed."""

    words: int
    radius: int
    least: float
    ids: list[int] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    #: the lengths of the items in words, and the index of all items, of one kind where their lengths are equal
    sizes: list[int] = field(default_factory=list)
    index: Blocks | None = None
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], words: int, radius: int, least: float) -> Items:
        self = cls(words, radius, least)
        lengths: list[int] = []
        prints: list[np.ndarray] = []
        hashed: dict[int, list[np.ndarray]] = {}
        for item, text in rows:
            found = words_of(text)
            if not found:
                continue
            wide = min(words, len(found))
            shingles = [b" ".join(found[i : i + wide]) for i in range(len(found) - wide + 1)]
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found])
            hashed.setdefault(wide, []).append(_mix(codes, wide))
            lengths.append(len(found))
            self.ids.append(item)
            self.counts.append(Counter(shingles))
            prints.append(_prints(_bits(shingles).sum(0, dtype=np.int64), len(shingles))[0])
        if prints:
            self.sizes = sorted(set(lengths))
            self.index = Blocks(np.array(prints), np.searchsorted(self.sizes, lengths))
        self.hashes = {wide: np.unique(np.concatenate(x)) for wide, x in hashed.items()}
        return self

    def _shared(self, codes: np.ndarray, wide: int) -> np.ndarray:
        """Places where a shingle of ``wide`` words begins that some item has."""
        if len(codes) < wide:
            return np.zeros(0, np.int64)
        known = codes >= 0
        whole = known[: len(codes) - wide + 1].copy()
        for k in range(1, wide):
            whole &= known[k : len(codes) - wide + 1 + k]
        places = np.flatnonzero(whole)
        if not len(places):
            return places
        mixed = _mix(codes, wide)[places]
        table = self.hashes[wide]
        return places[table[np.minimum(np.searchsorted(table, mixed), len(table) - 1)] == mixed]

    def found_in(self, text: bytes) -> dict[int, tuple[float, int]]:
        """{item id: (similarity, word at which its best window begins)} of the items in a text."""
        found = words_of(text)
        get = self.vocabulary.get
        codes = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
        best: dict[int, tuple[float, int]] = {}
        for wide in self.hashes:
            places = self._shared(codes, wide)
            if not len(places):
                continue
            self._whole(found, wide, best)
            # Stretches of neighbouring shared shingles, so that a long text is never fingerprinted at once.
            cuts = np.flatnonzero((np.diff(places) > STRETCH // 4) | (np.diff(places // STRETCH) > 0)) + 1
            for group in np.split(places, cuts):
                self._windows(found, group, wide, best)
        return best

    def _windows(self, found: list[bytes], places: np.ndarray, wide: int, best: dict[int, tuple[float, int]]) -> None:
        sizes = [s for s in self.sizes if min(self.words, s) == wide and s <= len(found)]
        if not sizes:
            return
        first = max(0, int(places[0]) - max(sizes) + wide)
        last = min(len(found), int(places[-1]) + max(sizes))
        here = found[first:last]
        shingles = [b" ".join(here[i : i + wide]) for i in range(len(here) - wide + 1)]
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(shingles), axis=0, dtype=np.int32)])
        shared = np.zeros(len(shingles) + 1, np.int32)
        shared[1:] = np.cumsum(np.isin(np.arange(first, first + len(shingles)), places))
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        for size in sizes:
            span = size - wide + 1  # shingles of a window
            if span <= len(shingles):
                starts = np.flatnonzero(shared[span:] > shared[:-span])
                waiting.append((size, starts, _prints(sums[starts + span] - sums[starts], span)))
            if waiting and (size == sizes[-1] or sum(len(starts) for _, starts, _ in waiting) > WINDOWS):
                lengths, starts, prints = (np.concatenate(x) for x in zip(*((np.full(len(t), n), t, f) for n, t, f in waiting), strict=True))
                windows = Blocks(prints, np.searchsorted(self.sizes, lengths))
                for row, member in zip(*windows.within(self.radius, self.index), strict=True):
                    start = int(starts[row])
                    bag = Counter(shingles[start : start + int(lengths[row]) - wide + 1])
                    self._verify(bag, int(member), first + start, best)
                waiting = []

    def _whole(self, found: list[bytes], wide: int, best: dict[int, tuple[float, int]]) -> None:
        """Compares a whole text with the longer items that it may still be similar enough to."""
        many = len(found) - wide + 1
        sizes = [s for s in self.sizes if s > len(found) and min(self.words, s) == wide and many >= self.least * (s - wide + 1)]
        if not sizes:
            return
        shingles = [b" ".join(found[i : i + wide]) for i in range(many)]
        mark = _prints(_bits(shingles).sum(0, dtype=np.int64), many)
        window = Counter(shingles)
        for at in range(0, len(sizes), WINDOWS):
            kinds = np.searchsorted(self.sizes, sizes[at : at + WINDOWS])
            for member in Blocks(np.repeat(mark, len(kinds), axis=0), kinds).within(self.radius, self.index)[1].tolist():
                self._verify(window, member, 0, best)

    def _verify(self, window: Counter, member: int, start: int, best: dict[int, tuple[float, int]]) -> None:
        """Keeps the window if its weighted similarity to an item is high enough and its best."""
        item = self.counts[member]
        both = sum(min(many, window[s]) for s, many in item.items() if s in window)
        alike = both / (window.total() + item.total() - both)
        old = best.get(self.ids[member])
        if alike >= self.least and (old is None or alike > old[0]):
            best[self.ids[member]] = (alike, start)


def _mix(codes: np.ndarray, wide: int) -> np.ndarray:
    """A 64-bit hash of every run of ``wide`` codes."""
    many = len(codes) - wide + 1
    mixed = np.zeros(many, np.uint64)
    values = codes.astype(np.uint64)
    for k in range(wide):
        mixed = (mixed ^ values[k : k + many]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size, one after another."""
    rows: list[tuple[int, bytes]] = []
    size = 0
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    for item, text in items.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).orderBy(item_col).toLocalIterator():
        rows.append((item, text.encode()))
        size += len(text) // 4
        if size > PASS_WORDS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 5,
    least: float = 0.8,
    radius: int = 72,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, contaminated, item_ids, similarity, start_word) of every row.

    An item is in a document if a window of its number of words, or all of a shorter document, has a weighted similarity (sum of the smaller over sum
    of the larger counts of each shingle) of at least ``least``; start_word is where the best window begins, null
    without one. At a similarity of 0.8 windows' fingerprints differ in some 40 of 256 bits, other texts' in 128: 72 lies over 5
    standard deviations above the one and 7 below the other. Items shorter than ``words`` words count as one shingle. Items without words or with a null id are passed
    over, null and empty documents are clean. The benchmark is read in blocks of a fixed size, one pass over the
    documents each. Rows with one id count as one document, as do those with a null id.
    """
    hits = _hits(docs, benchmark, words, least, radius, id_col, text_col, item_col, item_text_col)
    best = F.max(F.struct("similarity", F.negate("start_word").alias("back")))
    per_doc = hits.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), best.alias("best"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"),
        F.negate("best.back").alias("start_word"),
    )


def _hits(
    docs: DataFrame, benchmark: DataFrame, words: int, least: float, radius: int, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> DataFrame:
    """(id, item, similarity, start_word) of every item found in a document."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, similarity double, start_word long"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                rows = [
                    (doc, item, alike, start)
                    for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)
                    for item, (alike, start) in items.found_in(text).items()
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "item", "similarity", "start_word"])

        return narrow.mapInArrow(run, schema)

    context = docs.sparkSession.sparkContext
    found = docs.sparkSession.createDataFrame([], schema)
    for rows in _passes(benchmark, item_col, item_text_col):
        found = found.unionByName(written(search(context.broadcast(Items.of(rows, words, radius, least))), "hits"))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Rows with a null id stay. Rows of one id go together. Null and empty texts stay, as do all rows where the benchmark is
    empty; an empty table stays empty.
    """
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    name = free_name(docs, "bad")
    bad = found.where("contaminated and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(id_col).cast("long") == F.col(name), "left_anti")
