"""Run registered queries against their SQL twins and report differences."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows={len(got[1])}", True
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", False
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"{len(got[1])} vs {len(want[1])} rows; only ours {sorted(a)[:3]}; only sql {sorted(b)[:3]}", False
    return f"rows={len(got[1])}", True


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main(argv):
    from tests.conftest import build_session

    import __spark_entry__ as entry

    sf = argv[0]
    names = argv[1:]
    spark = build_session()
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            message, ok = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as e:  # report and go on
            message, ok = f"{type(e).__name__}: {str(e)[:600]}", False
        bad += not ok
        twin = "sql" if name in oracle else "rows"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {twin} {time.time() - start:6.2f}s {message}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
