"""Compare every registered query with its check SQL: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    database = duckdb.connect()
    for name in TABLES:
        database.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return database


def plain(value):
    if isinstance(value, float):
        return ("f", repr(round(value, 9)))
    return value


def shaped(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark, database, folder: str, name: str) -> str:
    """Empty when equal, else what differs."""
    frame = contract.queries()[name](spark, folder)
    got = shaped(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = database.execute(contract.oracle_sql()[name])
    want = shaped([column[0] for column in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    different = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if different:
        a, b = different[0]
        return f"{len(different)} rows differ, first {str(a)[:400]} != {str(b)[:400]}"
    return ""


def main() -> int:
    from parley.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark, database = local_session("check"), connect(folder)
    names = sys.argv[2:] or sorted(contract.queries())
    bad = 0
    for name in names:
        begin = time.time()
        try:
            problem = compare(spark, database, folder, name)
        except Exception as failure:
            problem = f"{type(failure).__name__}: {str(failure)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
