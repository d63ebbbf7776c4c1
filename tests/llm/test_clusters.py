import hashlib
import math

import numpy as np

from tests.oracle_check import compare, connect
from thornwall.llm import clusters
from thornwall.llm.queries import ORACLE_SQL, QUERIES


def slow(rows, k=16, rounds=3, size=64, scale=64):
    kept = []
    for vec, x in rows:
        if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x):
            cells = [math.floor(scale * v) for v in x]
            if max(map(abs, cells)) <= clusters.LARGEST:
                kept.append((vec, cells))
    name = lambda vec: hashlib.sha256(f"1:{vec}".encode()).hexdigest()
    start = sorted((name(vec), np.array(c).astype("<i4").tobytes(), c) for vec, c in kept if vec is not None)[:k]
    centres = [c for _, _, c in start]
    if not centres:
        return []
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((square(c, m), n) for n, m in enumerate(centres)) for _, c in kept]
    for _ in range(rounds):
        where = assign()
        for n in range(len(centres)):
            own = [c for (_, m), (_, c) in zip(where, kept, strict=True) if m == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    where = assign()
    totals = [sum(d for d, m in where if m == n) for n in range(len(centres))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(str((vec, n, d, totals[n], sum(totals), hashes[n])) for (vec, _), (d, n) in zip(kept, where, strict=True))


def got(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(str(tuple(r[n] for n in names)) for r in df.collect())


def test_query_equals_its_sql(spark, sf):
    assert compare(spark, connect(sf), sf, "op12_clusters", QUERIES["op12_clusters"], ORACLE_SQL["op12_clusters"]) is None


def table(spark, rows):
    rows = [(vec, x, 1, "x", 0.5) for vec, x in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, cells string, distance double").repartition(4)


def test_odd_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=8).round(1).tolist()) for i in range(200)]
    rows += [(int(i), (np.eye(8)[i % 8] * 50).tolist()) for i in range(200, 260)]  # many ties
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (300, None), (301, []), (302, [1.0] * 7), (303, [None] + [1.0] * 7)]
    rows += [(304, [float("nan")] * 8), (305, [float("inf")] + [0.0] * 7), (306, [1e300] + [0.0] * 7), (307, [1e6] * 8), (308, [0.0] * 8)]
    for k, lead in ((16, 3), (5, 8), (4, 1)):
        assert got(clusters.cluster(table(spark, rows), k=k, size=8, lead=lead)) == slow(rows, k=k, size=8)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 4) for i in range(3)]
    assert got(clusters.cluster(table(spark, rows), size=4, lead=2)) == slow(rows, size=4)
    same = [(i, [0.25, -0.5]) for i in range(40)]  # all centroids alike: all but one end up empty and stay
    assert got(clusters.cluster(table(spark, same), size=2, lead=1)) == slow(same, size=2)
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        assert clusters.cluster(table(spark, rows), size=2, lead=1).count() == 0


def test_bounds_never_exceed_and_rule_out():
    rng = np.random.default_rng(5)
    shape = rng.normal(size=(64, 64)) * (0.7 ** np.arange(64))[:, None] * 400  # variance falls along the axes
    cells = np.floor(rng.normal(size=(3000, 64)) @ shape).astype(np.int64)
    mean = cells.mean(0)
    axes = np.linalg.eigh(np.cov(cells.T))[1][:, ::-1][:, :16]
    turned = clusters.Rotation(mean, axes)
    assigner = clusters.Assigner(cells[:16], turned)
    lead, rest = turned.project(cells)
    exact = ((cells[:, None] - cells[:16]) ** 2).sum(2)
    assert (assigner.bounds(lead, rest) <= exact).all()
    cluster, best = assigner.nearest(cells, lead, rest)
    assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert assigner.computed < 1.2 * len(cells)  # of 16 a vector
