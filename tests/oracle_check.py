"""Run registered queries against their SQL on the same tables and report differences.

Usage: python tests/oracle_check.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return float(f"{value:.10g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, connection, sf_dir: str, name: str, run, sql: str) -> str | None:
    """None where both agree, else what differs."""
    df = run(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.sql(sql)
    expected = rows(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} / {sorted(result.columns)}"
    if len(got) != len(expected):
        return f"rows {len(got)} / {len(expected)}"
    different = [(g, e) for g, e in zip(got, expected) if g != e]
    if different:
        g, e = different[0]
        parts = [(c, x, y) for c, x, y in zip(sorted(df.columns), g, e) if x != y]
        return f"{len(different)} of {len(got)} rows differ, first: {str(parts)[:700]}"
    if not got:
        return "no rows"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry

    from thornwall.config import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    session = local_session(8)
    db = connect(folder)
    sqls = entry.oracle_sql()
    for query, function in entry.queries().items():
        if wanted and query not in wanted:
            continue
        begun = time.time()
        if query not in sqls:
            print(f"ROWS {query}: {function(session, folder).count()} ({time.time() - begun:.1f} s)", flush=True)
            continue
        try:
            problem = compare(session, db, folder, query, function, sqls[query])
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'OK  ' if problem is None else 'FAIL'} {query} {problem or ''} ({time.time() - begun:.1f} s)", flush=True)
