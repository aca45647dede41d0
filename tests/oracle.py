"""Compares registered queries with their SQL twins: ``python tests/oracle.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, query, sql):
    """('ok' | what differs, rows, Spark seconds, DuckDB seconds)."""
    start = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return "rows only", len(rows), spent, 0.0
    start = time.time()
    rel = con.sql(sql)
    want, names = rel.fetchall(), list(rel.columns)
    duck_time = time.time() - start
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows), spent, duck_time
    a, b = sorted_rows(df.columns, rows), sorted_rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", len(rows), spent, duck_time
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]}", len(rows), spent, duck_time
    kinds = [(n, type(x).__name__, type(y).__name__) for n, x, y in zip(sorted(names), a[0], b[0])
             if type(x) is not type(y) and x is not None and y is not None] if a else []
    return (f"types {kinds}" if kinds else "ok"), len(rows), spent, duck_time


def main(argv):
    import __spark_entry__ as e
    from motefield.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(folder), e.oracle_sql()
    failed = []
    for name, query in e.queries().items():
        wanted = [p for p in argv[1:] if p != "-v"]
        if wanted and not any(name.startswith(p) for p in wanted):
            continue
        try:
            verdict, n, t, d = compare(spark, con, folder, name, query, sql.get(name))
        except Exception as err:  # noqa: BLE001
            verdict, n, t, d = f"{type(err).__name__}: {str(err)[:600]}", 0, 0.0, 0.0
            if "-v" in argv:
                import traceback

                traceback.print_exc()
        if verdict not in ("ok", "rows only"):
            failed.append(name)
        print(f"{name:36s} {n:8d} rows  spark {t:6.2f}s  duck {d:6.2f}s  {verdict}", flush=True)
    print("FAILED" if failed else "ALL OK", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
