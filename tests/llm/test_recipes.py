import hashlib
import random

import pytest

from tests.llm.conftest import SCHEMA, prose, row
from tests.oracle_check import compare, connect
from thornwall.llm import chunks
from thornwall.llm.queries import ORACLE_SQL, QUERIES


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def slow(rows):
    """Sorted (doc_id, keep_id, group_size, text_sha256) and, per text, how many rows are kept: one."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(fold(text), []).append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, max(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out)), len(groups)


def found(report):
    rows = report.collect()
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows), rows


def test_query_equals_its_sql(spark, sf):
    assert compare(spark, connect(sf), sf, "op11_recipes", QUERIES["op11_recipes"], ORACLE_SQL["op11_recipes"]) is None


@pytest.mark.parametrize("size", [16, 1])  # one byte: nearly all chunks collide
def test_odd_rows_match_brute_force(spark, odd, none, size):
    shouted = [row(900 + i, (r.text or "").upper()) for i, r in enumerate(odd.limit(40).collect())]
    docs = odd.unionByName(spark.createDataFrame(shouted, SCHEMA)).repartition(6)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected, texts = slow(rows)
    got, report = found(chunks.exact_duplicates(docs, size=size))
    assert got == expected
    kept = [r for r in report if r.kept]
    assert len(kept) == texts and all(r.doc_id == r.keep_id for r in kept)
    assert chunks.exact_duplicates(none, size=size).count() == 0


def test_rows_that_stay_are_whole(spark, odd, none):
    rows = odd.collect()
    kept = chunks.deduplicate(odd)
    assert kept.columns == odd.columns
    got = kept.collect()
    assert len(got) == len({fold(r.text) for r in rows})
    assert all(r in rows for r in got)
    for r in got:
        assert r.doc_id == max((x.doc_id for x in rows if fold(x.text) == fold(r.text) and x.doc_id is not None), default=None)
    assert chunks.deduplicate(none).count() == 0
    clash = odd.withColumnRenamed("score", "row").withColumnRenamed("id", "_row")
    assert chunks.deduplicate(clash).count() == len(got)


def test_chunks_follow_the_content():
    rng = random.Random(2)
    base = prose(rng, 40000).encode()
    parts = chunks.chunks(base)
    assert b"".join(parts) == base and len(parts) > 20
    assert all(chunks.LEAST <= len(p) <= chunks.MOST for p in parts[:-1])
    moved = chunks.chunks(b"some words before it " + base)
    assert len(set(parts) & set(moved)) > 0.8 * len(parts)  # cuts come back into step
    assert chunks.chunks(b"") == [] and chunks.chunks(b"x") == [b"x"]
    flat = b"a" * 100_000  # nowhere to cut
    assert b"".join(chunks.chunks(flat)) == flat and max(map(len, chunks.chunks(flat))) <= chunks.MOST


def test_copies_beyond_one_task(spark):
    rng = random.Random(4)
    long = prose(rng, 5000)
    rows = [(i, long if i % 3 == 0 else long.upper() if i % 3 == 1 else f"{long} {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    expected, _ = slow(rows)
    assert found(chunks.exact_duplicates(docs))[0] == expected
