"""Nearest known attack: threshold search of vectors against a stored table of attack vectors.

Attacks are read in passes of bounded size, whatever their number. Within a pass they lie in blocks of neighbours; a
vector whose distances to some pivots differ from those of a whole block by more than the threshold allows skips the
block (triangle inequality), and what is left is bounded by a share of the coordinates and the norm of the others before
it is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwall.config import stored

PIVOTS, BLOCK = 8, 512
#: Bytes of attack vectors in one pass over the vectors.
PASS_BYTES = 1 << 26
#: Vectors that meet a block at a time, and numbers of the pairs of them that are compared in full at a time.
ROWS, PAIR_FLOATS = 512, 1 << 20
#: What rounding may add to a distance or a similarity.
SLACK = 1e-9


def _units(column, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a direction, their unit vectors) of a list column; only lists of ``size`` count if given."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    size = size if size is not None else int(lengths.max(initial=0))
    rows = np.flatnonzero((lengths == size) & (lengths > 0))
    flat = pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(float).reshape(-1, max(size, 1))
    with np.errstate(invalid="ignore", over="ignore"):
        norms = np.sqrt((flat**2).sum(1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], flat[good] / norms[good, None]


@dataclass
class Attacks:
    """Attack vectors of one length in blocks, each with its range of distances to every pivot."""

    ids: np.ndarray
    units: np.ndarray
    pivots: np.ndarray

    def __post_init__(self) -> None:
        far = self.distances(self.units)
        order = np.lexsort(np.round(far, 1).T[::-1])
        self.ids, self.units, far = self.ids[order], self.units[order], far[order]
        cuts = np.arange(0, len(self.ids), BLOCK)
        self.low, self.high = np.minimum.reduceat(far, cuts), np.maximum.reduceat(far, cuts)
        self.lead = max(1, self.units.shape[1] // 4)
        self.rest = np.sqrt((self.units[:, self.lead :] ** 2).sum(1))
        self.compared = 0

    def distances(self, units: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * units @ self.pivots.T))

    def nearest(self, units: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, id) of the nearest attack of each row at ``least`` or more; -1 where there is none."""
        parts = [self._nearest(units[n : n + ROWS], least) for n in range(0, len(units), ROWS)] or [self._nearest(units, least)]
        return np.concatenate([b for b, _ in parts]), np.concatenate([f for _, f in parts])

    def _nearest(self, units: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        best, found = np.full(len(units), -1.0), np.full(len(units), -1, np.int64)
        reach = np.sqrt(max(0.0, 2 - 2 * least)) + SLACK**0.5
        far = self.distances(units)
        rest = np.sqrt((units[:, self.lead :] ** 2).sum(1))
        for n in range(len(self.low)):
            gap = np.maximum(self.low[n] - far, far - self.high[n]).max(1)
            rows = np.flatnonzero(gap <= reach)
            if not len(rows):
                continue
            block = slice(n * BLOCK, (n + 1) * BLOCK)
            bound = units[rows, : self.lead] @ self.units[block, : self.lead].T + np.outer(rest[rows], self.rest[block])
            i, j = np.nonzero(bound >= np.maximum(best[rows], least)[:, None] - SLACK)
            if len(i) > 0.3 * bound.size:
                i, j = np.divmod(np.arange(bound.size), bound.shape[1])
                values = (units[rows] @ self.units[block].T).ravel()
            else:
                own, step = self.units[block], max(1, PAIR_FLOATS // units.shape[1])
                cuts = range(0, max(1, len(i)), step)
                values = np.concatenate([(units[rows[i[c : c + step]]] * own[j[c : c + step]]).sum(1) for c in cuts])
            self.compared += len(i)
            values = np.round(values, 12)  # equal vectors are equally near wherever they lie
            kept = np.flatnonzero(values >= least)
            kept = kept[np.lexsort((self.ids[block][j[kept]], -values[kept], i[kept]))]
            kept = kept[np.r_[True, i[kept][1:] != i[kept][:-1]]] if len(kept) else kept
            at, value, name = rows[i[kept]], values[kept], self.ids[block][j[kept]]
            better = (value > best[at]) | (value == best[at]) & ((name < found[at]) | (found[at] < 0))
            best[at[better]], found[at[better]] = value[better], name[better]
        return best, found


def _passes(attacks: DataFrame, attack_id: str, vec_col: str) -> Iterator[list[Attacks]]:
    """The attacks pass by pass, those of one length together. Pivots are the attacks of a pass that lie furthest apart."""
    rows = attacks.where(F.col(attack_id).isNotNull() & (F.size(vec_col) > 0))
    rows = rows.select(F.col(attack_id).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.size(vec_col).alias("size"))

    def made(held: list) -> list[Attacks]:
        out = []
        for size in sorted({len(v) for _, v in held}):
            own = [(i, v) for i, v in held if len(v) == size]
            places, units = _units(pa.array([v for _, v in own], pa.list_(pa.float64())), size)
            if not len(units):
                continue
            chosen = [0]
            near = units @ units[0]
            while len(chosen) < min(PIVOTS, len(units)):
                chosen.append(int(near.argmin()))
                near = np.maximum(near, units @ units[chosen[-1]])
            out.append(Attacks(np.array([own[p][0] for p in places.tolist()], np.int64), units, units[chosen]))
        return out

    held, size = [], 0
    for row in rows.orderBy("size", "id").toLocalIterator():
        held.append((row.id, row.v))
        size += 8 * len(row.v)
        if size >= PASS_BYTES:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def nearest_attacks(
    vectors: DataFrame,
    attacks: DataFrame,
    least: float,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    attack_id: str = "attack_id",
    attack_vec: str = "embedding",
) -> DataFrame:
    """(id, attack_id, similarity) of the vectors whose nearest attack has a cosine similarity of ``least`` (above 0) or more.

    At most one row per id, ties to the smaller attack id. Vectors and attacks that are null, empty or zero or hold null or
    non-finite components, attacks without an id, and pairs of different lengths do not meet. Rows repeated under one id
    count as one.
    """
    narrow = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    context = vectors.sparkSession.sparkContext
    hits = vectors.sparkSession.createDataFrame([], "id long, attack_id long, similarity double")
    for held in _passes(attacks, attack_id, attack_vec):
        shared = context.broadcast(held)  # PASS_BYTES of vectors

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for known in shared.value:
                    rows, units = _units(batch.column(1), known.units.shape[1])
                    best, found = known.nearest(units, least)
                    hit = found >= 0 if (known.ids >= 0).all() else best >= least
                    columns = [batch.column(0).take(pa.array(rows[hit])), pa.array(found[hit]), pa.array(best[hit])]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "attack_id", "similarity"])

        hits = hits.unionByName(stored(narrow.mapInArrow(run, "id long, attack_id long, similarity double"), "hits"))
    best = F.max(F.struct("similarity", F.negate("attack_id").alias("back"))).alias("best")
    return hits.groupBy("id").agg(best).select(
        F.col("id").alias(id_col), F.negate("best.back").alias("attack_id"), F.col("best.similarity").alias("similarity")
    )
