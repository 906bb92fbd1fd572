"""Run registered queries and their SQL on the same tables and compare.

``python tests/checker.py <sf_dir> [name ...]``
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
        if isinstance(v, float):
            return _cell(v)
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t = time.time()
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return False, f"{len(got)} rows, no SQL, {took:.1f}s"
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    took2 = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return True, f"{len(got)} rows, {took:.1f}s vs {took2:.1f}s"
    a = [r for r in got if r not in set(want)][:2]
    b = [r for r in want if r not in set(got)][:2]
    return False, f"{len(got)} vs {len(want)} rows\n   spark {str(a)[:1500]}\n   sql   {str(b)[:1500]}"


def main() -> int:
    import __spark_entry__ as entry
    from folioquery.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, note = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as exc:  # keep going, report at the end
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"\n## {'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"\n## {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
