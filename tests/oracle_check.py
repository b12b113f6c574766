"""Compare registered queries with their SQL on DuckDB: names, types, rows and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from tandemlens.sources.tables import TABLES


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def spark_kind(t: str) -> str:
    return {"bigint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool"}.get(t, t)


def duck_kind(t: str) -> str:
    t = str(t)
    known = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}
    return known.get(t, t)


def compare(spark, con, name, fn, sql, root):
    """Return (problem or None, rows, seconds)."""
    start = time.time()
    df = fn(spark, root)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return (None if rows else "no rows"), len(rows), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: duck_kind(d[1]) for d in cur.description}
    want_rows = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", len(rows), took
    mine = {n: spark_kind(t) for n, t in df.dtypes}
    diff = {n: (mine[n], kinds[n]) for n in cols if mine[n] != kinds[n]}
    if diff:
        return f"types {diff}", len(rows), took
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in want_rows]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    rows.sort(key=key)
    want.sort(key=key)
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}", len(rows), took
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {cols}: {bad[0]}", len(rows), took
    if not rows:
        return "no rows", 0, took
    return None, len(rows), took


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tandemlens.session import local_session

    root = argv[1]
    only = argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            problem, n, took = compare(spark, con, name, fn, sqls.get(name), root)
        except Exception as e:  # noqa: BLE001 - report every failing query
            problem, n, took = f"{type(e).__name__}: {str(e)[:700]}", -1, 0.0
        failed += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name} rows={n} {took:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
