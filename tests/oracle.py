"""Compare registered queries with their SQL run by DuckDB.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return ("num", str(v.normalize() + 0))
    if isinstance(v, bool):
        return ("bool", str(v))
    if isinstance(v, int):
        return ("num", str(Decimal(v).normalize() + 0))
    if isinstance(v, float):
        return ("float", "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, (list, tuple)):
        return ("list", str([plain(x) for x in v]))
    return (type(v).__name__, str(v))


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = as_rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not want:
        return "oracle gives no rows"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = make_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck_tables(sf_dir)
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                n = len(queries[name](spark, sf_dir).collect())
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.2f}s "
              f"{problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
