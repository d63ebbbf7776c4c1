import random
import re

import numpy as np
import xxhash

from tests.llm.conftest import prose, row, SCHEMA
from thornwall.llm import common, simhash
from thornwall.llm.common import components
from thornwall.llm.queries import QUERIES


def slow_print(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    wide = min(words, len(found))
    hashes = [xxhash.xxh64(" ".join(found[i : i + wide]).encode(), 42).intdigest() for i in range(len(found) - wide + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    """{node: smallest node reachable} by plain search."""
    out = {}
    for start in sorted(nodes):
        if start in out:
            continue
        out[start], todo = start, [start]
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in out and linked(a, b):
                    out[b] = start
                    todo.append(b)
    return out


def test_fingerprints_and_classes_match_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, []).append(slow_print(r.text))
    ids = [i for i in prints if i is not None]
    close = lambda a, b: any((x ^ y).bit_count() <= 3 for x in prints[a] for y in prints[b])
    # one id with two texts is two nodes that only share a name, so compare by fingerprint
    by_print = {}
    for i in ids:
        for p in prints[i]:
            by_print[p] = min(i, by_print.get(p, i))
    expected = classes(list(by_print.values()), close)
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        assert int(r.fingerprint, 16) in prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == (None if r.doc_id is None else expected[by_print[int(r.fingerprint, 16)]])


def test_the_query_equals_brute_force_on_the_small_table(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op1_simhash"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in texts.items()}
    expected = classes(list(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}


def smallest(found):
    """{node: smallest node with its root}."""
    low = {}
    for r in found:
        low[r.root] = min(r.node, low.get(r.root, r.node))
    assert all(r.root in {x.node for x in found} for r in found)
    return {r.node: low[r.root] for r in found}


def test_tiles_and_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MIN_TILE", 200)
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    prints = [int(s) for s in seeds]
    for s in seeds.tolist() * 12:
        prints.append(s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), 3)
    found = smallest(components(links).collect())
    values = np.array(prints, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    expected = classes(range(len(prints)), lambda a, b: near[a, b])
    place = {p: i for i, p in enumerate(signed)}
    groups = {}
    for i, p in enumerate(signed):
        groups.setdefault(found.get(p, p), []).append(place[p])
    assert {i: min(own) for own in groups.values() for i in own} == expected
    assert links.count() < 4 * len(prints)


def test_a_large_group_of_near_copies_costs_rows_in_proportion(spark):
    rng = random.Random(3)
    base = prose(rng, 4000).split()
    rows = []
    for i in range(600):
        words = list(base)
        for place in rng.sample(range(len(words)), 2):
            words[place] = f"edit{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(5000, " ".join(base)), (5001, "something else"), *rows], "doc_id long, text string").repartition(4)
    prints = simhash.fingerprints(docs).select("fingerprint").distinct()
    assert simhash.links(prints, 3).count() < 2 * 602
    near = {i: slow_print(t) for i, t in rows}
    near[5000] = slow_print(" ".join(base))
    expected = classes(list(near), lambda a, b: (near[a] ^ near[b]).bit_count() <= 3)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted({*expected.values(), 5001})
    assert len(set(expected.values())) < 100


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, None), (300, 299), (299, 300)]
    expected = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    table = spark.createDataFrame(edges, "a long, b long")
    for few in (1 << 20, 0):
        assert smallest(components(table, few).collect()) == expected
    assert components(table.limit(0), 0).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = common.written
    monkeypatch.setattr(common, "written", lambda df, name: (rounds.append(name), real(df, name))[1])
    chain = spark.range(1000).selectExpr("id as a", "id + 1 as b")
    assert set(smallest(components(chain, 0).collect()).values()) == {0}
    assert rounds.count("up") < 15
    rounds.clear()
    assert set(smallest(components(chain).collect()).values()) == {0} and "up" not in rounds


def test_deduplicate_keeps_one_of_each_class(spark, odd, none):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = prose(rng, 400).split()
        rows.append(row(10 * i, " ".join(words)))
        for k in range(1, 4):
            edited = list(words)
            for place in rng.sample(range(len(words)), i % 4):
                edited[place] = f"edit{k}"
            rows.append(row(10 * i + k, " ".join(edited).upper() if k == 3 else " ".join(edited)))
    rows += [row(9000, rows[0][1]), row(9001, "unlike anything else"), row(9002, None), row(9003, "")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(4))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    prints = {r[0]: slow_print(r[1]) for r in rows}
    expected = set(classes([r[0] for r in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3).values())
    assert set(ids) == expected and 60 < len(expected) < 200
    assert kept.columns == odd.columns
    assert simhash.deduplicate(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_no_text_is_lost_under_a_shared_id(spark, odd):
    texts = ["one text of some words", "another and quite different text"]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[0]), (5, texts[1]), (None, texts[0])]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, texts[0]), (5, texts[1]), (None, texts[0])], key=str)
    # on odd rows: every row that goes has a row that stays in its class, and of each class one row with an id stays
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    prints = sorted({slow_print(t) for i, t in rows if i is not None})
    class_of = classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    left = [(r.doc_id, r.text) for r in simhash.deduplicate(odd).collect()]
    stay = [(i, class_of[slow_print(t)]) for i, t in left if i is not None]
    assert len(stay) == len(set(class_of.values())) == len({c for _, c in stay})
    assert all(i == min(j for j, t in rows if j is not None and class_of[slow_print(t)] == c) for i, c in stay)
    assert sum(i is None for i, _ in left) == sum(i is None for i, _ in rows)
    named = odd.toDF("doc_id", "text", "row", "__node", "root", "first", "fingerprint", "many")
    assert simhash.deduplicate(named).columns == named.columns and simhash.deduplicate(named).count() == len(left)
