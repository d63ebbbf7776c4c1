import random
import re

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, prose, row
from thornwall.llm import ann, decontam
from thornwall.llm.queries import QUERIES


def slow_nearest(ids, vectors, k, every):
    out = {}
    for n, q in enumerate(ids):
        if q % every == 0:
            scores = [(-float((vectors[n] * v).sum()), i) for i, v in zip(ids, vectors, strict=True) if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r.vec_id for r in table], np.array([r.embedding for r in table], float)
    exact = slow_nearest(ids, vectors, 20, 20)
    got = {}
    for r in QUERIES["op2_multi_index"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(exact)
    hits = sum(len({i for i, _ in exact[q]} & {r.vec_id for r in got[q]}) for q in exact)
    assert hits >= 0.9 * 20 * len(exact)
    place = {i: n for n, i in enumerate(ids)}
    for q, rows in got.items():
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(vectors[place[q]] @ vectors[place[r.vec_id]]), abs=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)


def test_a_full_walk_is_exact_with_ties_and_crowded_cells(spark, monkeypatch):
    for name, value in (("GROUP", 64), ("STEP", 3)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(6)
    vectors = np.concatenate([np.tile(rng.normal(size=6), (300, 1)), rng.integers(-2, 3, (300, 6)).astype(float) + 0.5])
    ids = rng.permutation(2000)[:600].tolist()
    rows = [(i, v.tolist(), 0, 1.0) for i, v in zip(ids, vectors, strict=True)]
    bad = [(20, None), (40, []), (60, [0.0] * 6), (80, [float("nan")] + [1.0] * 5), (100, [float("inf")] * 6), (120, [None] + [1.0] * 5), (None, [1.0] * 6)]
    rows = [r for r in rows if r[0] not in {b[0] for b in bad}] + [(*b, 0, None) for b in bad]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, score double").repartition(5)
    good = [(r[0], np.array(r[1])) for r in rows[: -len(bad)]]
    exact = slow_nearest([i for i, _ in good], [v for _, v in good], 5, 20)
    got = {}
    for r in ann.nearest(table, k=5, every=20, cells=4, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score)))
    assert got == exact
    assert ann.nearest(table.limit(0)).count() == 0
    few = table.where("vec_id is not null and size(embedding) = 6").orderBy("vec_id").limit(3)
    assert ann.nearest(few, k=5, every=1, cells=4).groupBy("query_id").count().where("count > 2").count() == 0


def test_one_vector_of_another_length_leaves_the_others(spark):
    rng = np.random.default_rng(8)
    ids, vectors = list(range(1, 81)), rng.normal(size=(80, 6))
    rows = [(0, [1.0, 2.0]), (100, [1.0] * 9), *((i, v.tolist()) for i, v in zip(ids, vectors, strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(table, k=5, every=20, cells=4, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score)))
    assert got == slow_nearest(ids, vectors, 5, 20)
    counted = {r.length: (r.vectors, r.searched) for r in ann.left_out(table).collect()}
    assert counted == {2: (1, False), 6: (80, True), 9: (1, False)} and ann.left_out(table.limit(0)).count() == 0


def test_each_entry_is_sent_once(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    plan = ann.nearest(table, every=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "CoGroup" not in plan


def test_cells_grow_with_the_square_root():
    assert [ann.cells_for(n, 64) for n in (0, 500, 10_000, 160_000, 10**9)] == [64, 64, 64, 128, 1138]
    assert ann.cells_for(10**9, 64) ** 2 / 10**4.5 < 1.01 * ann.cells_for(10**4, 64) ** 2 / 10**2


def test_the_walk_goes_by_rising_sums():
    rng = np.random.default_rng(7)
    left, right = rng.normal(size=9), rng.normal(size=7)
    cells = ann.walk(left, right, np.ones(63, int), 63)
    sums = [left[c // 7] + right[c % 7] for c in cells]
    assert sorted(cells) == list(range(63)) and sums == sorted(sums)
    assert len(ann.walk(left, right, np.ones(63, int), 10)) == 10


def slow_items(text, items, least=0.8, wide=5):
    fold = lambda t: re.sub(r"[!-/:-@\[-`{-\x7f]", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")).encode().split()
    words, found = fold(text), set()
    for item, item_text in items:
        own = fold(item_text)
        if not own or item is None:
            continue
        k = min(wide, len(own))
        bag = lambda ws: sorted(b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
        target = bag(own)
        for start in range(max(1, len(words) - len(own) + 1)):
            window, both = bag(words[start : start + len(own)]), 0
            for shingle in set(window):
                both += min(window.count(shingle), target.count(shingle))
            if both >= least * (len(window) + len(target) - both):
                found.add(item)
                break
    return found


def test_contamination_matches_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(decontam, "STRETCH", 64)
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(15, 60), 60)) for i in range(25)] + [(90, "Only Three Words"), (91, ""), (92, None), (None, "null id"), (93, "!!")]
    rows = []
    for i in range(120):
        words = items[i % 25][1].split()
        for place in rng.sample(range(len(words)), min(len(words), i // 30)):
            words[place] = "edited"
        middle = " ".join(words) if i % 4 else items[i % 25][1].upper().replace(" ", "\n")
        rows.append(row(i, f"{prose(rng, rng.randint(0, 80), 60)} {middle} {prose(rng, rng.randint(0, 80), 60)}"))
    rows += [row(200, "has only three words!"), row(201, None), row(202, ""), row(203, prose(rng, 300, 60)), (None, items[0][1], *[None] * 6)]
    docs, benchmark = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(items, "item_id long, text string")
    expected = {r[0]: slow_items(r[1], items) for r in rows}
    for block in (300_000, 200):  # one pass and several
        monkeypatch.setattr(decontam, "PASS_WORDS", block)
        got = {r.doc_id: r for r in decontam.contamination(docs, benchmark).collect()}
        assert {i: set(r.item_ids) for i, r in got.items()} == expected
        assert all(r.contaminated == bool(expected[i]) and (r.similarity >= 0.8) == r.contaminated for i, r in got.items())
    clean = decontam.decontaminate(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, found in expected.items() if not found} | {None}
    assert clean.columns == docs.columns
    assert decontam.contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(none, benchmark).count() == 0


def test_documents_shorter_than_an_item_are_compared_whole(spark):
    rng = random.Random(10)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 30, 12, 9, 6, 5, 4, 60])]
    rows = []
    for i, text in items:
        words = text.split()
        rows += [(100 * i + cut, " ".join(words[:-cut])) for cut in (1, 2, 3)] + [(100 * i + 10 + cut, " ".join(words[cut:])) for cut in (1, 8)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, benchmark).collect()}
    assert {i: set(r.item_ids) for i, r in got.items()} == {i: slow_items(t, items) for i, t in rows}
    assert got[1].similarity == pytest.approx(25 / 26) and got[1].start_word == 0 and got[301].similarity == pytest.approx(0.8)
    assert not got[18].contaminated and not got[402].contaminated


def test_the_index_finds_all_within_the_radius_and_selects():
    rng = np.random.default_rng(11)
    own = rng.integers(0, 2**32, (300, decontam.BLOCKS), dtype=np.uint32)
    own[7] = own[8]
    prints = np.concatenate([own[rng.integers(0, 300, 400)], rng.integers(0, 2**32, (400, decontam.BLOCKS), dtype=np.uint32)])
    for n in range(400):  # up to 100 bits changed
        for bit in rng.permutation(decontam.BITS)[: n // 4]:
            prints[n, bit // 32] ^= np.uint32(1 << int(bit % 32))
    prints = np.concatenate([prints, prints[:5]])
    kinds, item_kinds = rng.integers(0, 3, len(prints)), rng.integers(0, 3, 300)
    apart = np.bitwise_count(prints[:, None] ^ own).sum(-1)
    same = kinds[:, None] == item_kinds
    for radius in (0, 3, 9, 72, 100):
        assert sum(b + 1 for b in decontam.limits(radius)) >= radius + 1
        got = decontam.Blocks(prints, kinds).within(radius, decontam.Blocks(own, item_kinds))
        assert set(zip(*(x.tolist() for x in got), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero((apart <= radius) & same)), strict=True))
        assert len(got[0]) == len(set(zip(*(x.tolist() for x in got), strict=True)))
    passed = np.zeros((400, 300), bool)
    for block, limit in enumerate(decontam.limits(72)):
        passed |= np.bitwise_count(prints[400:800, block, None] ^ own[:, block]) <= limit
    assert passed.mean() < 0.05


def test_similar_windows_lie_within_the_radius():
    rng = random.Random(12)
    distances = []
    while len(distances) < 1500:
        words = prose(rng, rng.randint(13, 80), 5000).encode().split()
        edited = list(words)
        edited[-max(1, (len(words) - 4) // 9) :] = prose(rng, max(1, (len(words) - 4) // 9), 5000).encode().split()
        bags = [[b" ".join(w[i : i + 5]) for i in range(len(w) - 4)] for w in (words, edited)]
        both = len(set(bags[0]) & set(bags[1]))
        if both >= 0.8 * (len(bags[0]) + len(bags[1]) - both):
            marks = [decontam._prints(decontam._bits(bag).sum(0, dtype=np.int64), len(bag)) for bag in bags]
            distances.append(int(np.bitwise_count(marks[0] ^ marks[1]).sum()))
    assert max(distances) <= 72 and 25 < np.mean(distances) < 45
