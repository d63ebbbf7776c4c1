import hashlib

from tests.oracle_check import compare, connect
from thornwall.llm import lines
from thornwall.llm.queries import ORACLE_SQL, QUERIES

SPACE = " \t\n\x0b\x0c\r"


def slow(rows, least=10):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                first[key(line)] = min(doc, first.get(key(line), doc))
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if doc is None or len(key(x)) < least or first[key(x)] == doc]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def test_query_equals_its_sql(spark, sf):
    assert compare(spark, connect(sf), sf, "op10_lines", QUERIES["op10_lines"], ORACLE_SQL["op10_lines"]) is None


def test_odd_rows_match_brute_force(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in lines.line_report(odd).collect()) == slow(rows)
    assert lines.line_report(none).count() == 0
    kept = lines.deduplicate_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_a_line_of_most_documents_spreads_over_partitions(spark):
    rows = [(i, f"  The SAME long line\nown line number {i % 700}\nshort\n\n the same long LINE \t") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(str(tuple(r)) for r in lines.line_report(docs).collect()) == slow(rows)
    maps = {r.id: r.keep for r in lines.keep_bitmaps(docs).collect()}
    assert 0 not in maps and len(maps) == 2999
    assert lines.kept_lines(rows[5][1].encode(), maps[5])[0] == b"own line number 5\nshort\n"
    texts = {r.doc_id: r.text for r in lines.deduplicate_lines(docs).collect()}
    assert texts[0] == rows[0][1] and texts[1] == "own line number 1\nshort\n" and texts[701] == "short\n"
