"""Language of whole texts by bit-sliced Bloom filters.

Every slot of the filter table holds a bit for each language (in words of 64 where there are more), so one lookup returns
all languages that contain an n-gram: the masks of its slots, and-ed. A text's n-grams are counted per language, the counts corrected for the share of
n-grams that a filter lets through by chance, and the language with the largest corrected count is the answer.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwall.llm.common import some_of_each

#: Lengths of n-grams in characters, word edges included, and hash probes per n-gram.
SIZES, PROBES = (3, 4), 3
#: Characters counted at once.
STEP = 1 << 20
#: Languages of one table, the bits of its widest mask.
WORD = 64
SPACE = 32


@cache
def is_letter() -> np.ndarray:
    """Whether each code point is a letter; kept for the life of the worker."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _points(text: str) -> np.ndarray:
    """Lower-case code points between two spaces, every run of other characters than letters one space."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(is_letter()[points], points, np.uint32(SPACE))
    space = points == SPACE
    return points[~(space & np.r_[False, space[:-1]])]


def grams(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams with no space but at their ends."""
    found = []
    space = points == SPACE
    for size in SIZES:
        many = len(points) - size + 1
        if many < 1:
            continue
        mixed = np.full(many, size, np.uint64)
        clean = np.ones(many, bool)
        for k in range(size):
            mixed = (mixed ^ points[k : k + many]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            if 0 < k < size - 1:
                clean &= ~space[k : k + many]
        found.append(mixed[clean])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


@dataclass
class Filters:
    """The bit-sliced filters of all languages: a table of masks for each ``WORD`` languages, over the same slots."""

    names: list[str]
    tables: list[np.ndarray]
    chance: np.ndarray

    @classmethod
    def of(cls, names: list[str], members: list[np.ndarray]) -> Filters:
        """``members`` are the n-grams of each language; the table has some 16 slots for each of the largest set."""
        slots = 1 << max(10, (16 * max(map(len, members), default=1)).bit_length())
        tables, chance = [], []
        for first in range(0, len(names), WORD):
            own = members[first : first + WORD]
            kind = np.uint8 if len(own) <= 8 else np.uint16 if len(own) <= 16 else np.uint64
            table = np.zeros(slots, kind)
            for bit, hashes in enumerate(own):
                for probe in range(PROBES):
                    table[cls._slot(hashes, probe, slots)] |= kind(1 << bit)
            tables.append(table)
            chance += [((table >> kind(bit)) & kind(1)).mean() ** PROBES for bit in range(len(own))]
        return cls(names, tables, np.array(chance))

    @staticmethod
    def _slot(hashes: np.ndarray, probe: int, slots: int) -> np.ndarray:
        return ((hashes * np.uint64(2 * probe + 1) + (hashes >> np.uint64(21 + 7 * probe))) >> np.uint64(7)) & np.uint64(slots - 1)

    def masks(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The languages that contain each n-gram: for each ``WORD`` languages a mask with a bit for each."""
        if not self.tables:
            return []
        places = [self._slot(hashes, probe, len(self.tables[0])) for probe in range(PROBES)]
        return [np.bitwise_and.reduce([table[at] for at in places]) for table in self.tables]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the evidence); ``und`` and 0 for a text without letters."""
        counts = np.zeros(len(self.names), np.int64)
        total = 0
        letters = False
        for at in range(0, len(text or ""), STEP):
            points = _points(text[at : at + STEP])
            letters = letters or bool((points != SPACE).any())
            hashes = grams(points)
            total += len(hashes)
            masks = self.masks(hashes)
            for n in range(len(self.names)):
                mask = masks[n // WORD]
                counts[n] += np.count_nonzero(mask & mask.dtype.type(1 << n % WORD))
        if not letters or not self.names:
            return "und", 0.0
        real = np.maximum(0, (counts - total * self.chance) / (1 - self.chance))
        best = int(real.argmax())
        return self.names[best], float(real[best] / real.sum()) if real.sum() else 0.0


def learn(labelled: DataFrame, per_language: int = 400, min_share: float = 0.01, languages: int = 1024) -> Filters:
    """Filters from ``labelled`` (id, text, lang): at most ``per_language`` texts of each language.

    The texts with the smallest hash of their id are taken. A filter holds the n-grams that are in at least ``min_share`` of
    its texts, and in two at least where there are ten or more. Null texts and languages teach nothing. More than
    ``languages`` of them raise ValueError, since their filters would not fit a worker.
    """
    known = labelled.where("id is not null and lang is not null and text is not null")
    chosen = some_of_each(known.select("id", "lang"), "lang", per_language, languages)
    wanted = labelled.where(F.col("id").isin([i for i, _ in chosen]) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(grams(_points(text))).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "grams"])

    texts: Counter = Counter()
    shared: dict[str, list[np.ndarray]] = {}
    for row in wanted.select("lang", "text").mapInArrow(run, "lang string, grams binary").toLocalIterator():
        texts[row.lang] += 1
        shared.setdefault(row.lang, []).append(np.frombuffer(row.grams, np.uint64))
    members = []
    for lang in sorted(texts):
        hashes, many = np.unique(np.concatenate(shared[lang]), return_counts=True)
        least = max(2 if texts[lang] >= 10 else 1, int(np.ceil(min_share * texts[lang])))
        members.append(hashes[many >= least])
    return Filters.of(sorted(texts), members)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone.

    ``und`` with score 0 where the text is null, empty or without letters; ties go to the first name in order; a text
    with letters and no known n-gram gets the first language with score 0. Repeated rows are scored alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [filters.predict(text) for text in batch.column(1).to_pylist()]
            columns = [pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


def in_fold(id_col: str, folds: int, fold: int):
    """Whether crc32(id as text) mod ``folds`` is ``fold``; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def language_report(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): filters learnt outside the held-out fold, every text predicted."""
    labelled = docs.where(~in_fold("doc_id", 4, 2)).select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    found = identify(docs, learn(labelled, per_language))
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
