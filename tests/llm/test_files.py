import base64
import hashlib
import io

import pytest

from thornwall.config import shared_folder
from thornwall.llm import shards, warc
from thornwall.llm.queries import QUERIES
from thornwall.llm.shards import shard_by_bytes


def expected(rows, least):
    first = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= least:
            first[payload] = min(page, first.get(payload, page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        original = first.get(payload, page) if page is not None else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if original == page else "revisit", None if original == page else original))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    rows = [(i, f"http://h/{i}", ["same payload", "x" * i, None, "", "\x1f\x8b\x08 é"][i % 5]) for i in range(60)]
    rows += [(3, "http://again", None), (0, "u", "same payload"), (None, None, "same payload"), (99, "bad\r\nurl é", "y" * 300000), (100, None, "z")]
    pages = spark.createDataFrame([(*r, "d", "p") for r in rows], "page_id long, url string, html string, digest string, payload string").repartition(3)
    assert sorted(str(tuple(r)) for r in warc.archive_report(pages, least).collect()) == expected(rows, least)
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_every_split_gives_the_same_records(spark):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(sha2(cast(id as string), 256) as string), 20) as html")
    files = warc.write_archives(pages.repartition(2), shared_folder(spark))
    for split in (997, 5000, 1 << 20):
        got = warc.read_archives(files, split, payloads=True).collect()
        assert sorted(r.page_id for r in got) == list(range(300))
        assert all(hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest) for r in got)


def test_bytes_that_are_no_record_are_passed_over():
    records = [warc.record(i, "http://h", b"payload %d" % i, None) for i in range(4)]
    junk = warc.MAGIC + b"junk" + warc.MAGIC
    data = junk + records[0] + b"noise" + records[1] + junk + records[2] + records[3][:-9]
    found = [warc.parse(m)["page_id"] for m in warc.Members(io.BytesIO(data), 0, len(data))]
    assert found == [0, 1, 2]


def groups(rows):
    out = {}
    for doc, text in rows:
        first, size = out.get(text or "", (None, 0))
        key = doc if doc is not None else 1 << 63
        out[text or ""] = (key if first is None else min(first, key), size + len((text or "").encode()) + 8)
    return [size for _, size in sorted(out.values())]


def smallest_capacity(sizes, many):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, held = (low + high) // 2, 1, 0
        for size in sizes:
            if held + size > middle:
                used, held = used + 1, 0
            held += size
        low, high = (low, middle) if used <= many else (middle + 1, high)
    return low


@pytest.mark.parametrize("ladder,many", [(64, 24), (1024, 7), (8192, 24)])
def test_shards_are_minimax(spark, odd, sf, monkeypatch, ladder, many):
    monkeypatch.setattr(shards, "LADDER", ladder)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for table in (docs, odd):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = shard_by_bytes(table, many).collect()
        assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
        loads, slots, place = {}, {}, {}
        for r in got:
            loads[r.shard] = loads.get(r.shard, 0) + r.size
            slots.setdefault(r.shard, []).append(r.slot)
            place.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        assert max(loads.values()) == smallest_capacity(groups(rows), many)
        assert all(0 <= s < many for s in loads) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in place.values())


def test_the_queries_give_what_plain_code_gives(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(str(tuple(r)) for r in QUERIES["op8_warc"](spark, sf).select(columns).collect()) == expected(pages, 0)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got, loads = QUERIES["op9_shards"](spark, sf).collect(), {}
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len((t or "").encode()) + 8) for i, t in rows)
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert set(loads) <= set(range(24)) and max(loads.values()) == smallest_capacity(groups(rows), 24)


def test_shards_of_few_and_no_rows(spark, none):
    assert shard_by_bytes(none).count() == 0
    same = spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string").repartition(4)
    assert sorted((r.shard, r.slot, r.doc_id) for r in shard_by_bytes(same).collect()) == [(0, i, i) for i in range(50)]


def test_the_shard_query_runs_no_python(spark, odd):
    plan = shard_by_bytes(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
