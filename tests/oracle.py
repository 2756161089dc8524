"""Compare Spark results with the SQL equivalents run by DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message, seconds)"""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    spent = time.time() - start
    columns, mine = rows_of(df.columns, got)
    if sql is None:
        return True, f"{len(mine)} rows, no SQL", spent
    cur = con.execute(sql)
    names, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if columns != names:
        return False, f"columns {columns} against {names}", spent
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return False, (f"{len(mine)} rows against {len(theirs)}; only Spark {sorted(a - b)[:3]}; "
                       f"only SQL {sorted(b - a)[:3]}"), spent
    return True, f"{len(mine)} rows", spent


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from treeline.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session("8"), connect(sf)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, text, spent = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as exc:  # show and go on
            ok, text, spent = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {spent:6.2f}s {text}", flush=True)
    print("failures:", bad)
