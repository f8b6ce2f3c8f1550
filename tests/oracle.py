"""Run registered queries against their SQL twins in DuckDB and compare rows.

``python -m tests.oracle [sf_dir] [name …]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}"
    if isinstance(v, Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    return repr(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    took = time.time() - t0
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    if got != want:
        in_got, in_want = set(got), set(want)
        extra = [g for g in got if g not in in_want][:3]
        gone = [w for w in want if w not in in_got][:3]
        return False, f"rows {len(got)} vs {len(want)} cols {cols}\n   spark only {extra}\n   sql only {gone}"
    types = {c: str(t) for c, t in zip(names, [d[1] for d in res.description])}
    odd = [(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema.fields
           if not same_kind(f.dataType.simpleString(), types[f.name])]
    return True, f"{len(got)} rows, {took:.1f}s" + (f"  TYPES {odd}" if odd else "")


def same_kind(spark_type: str, duck: str) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
             "double": "DOUBLE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    return pairs.get(spark_type, spark_type) == duck or duck.startswith("TIMESTAMP") and spark_type.startswith("timestamp")


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from logloom.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = e.queries(), e.oracle_sql()
    wanted = argv[1:]
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - a report line per query
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + text, flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
