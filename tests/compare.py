"""Run registered queries against their DuckDB oracles and report differences.

Usage: python tests/compare.py [sf_dir] [query-name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if v is not None and not isinstance(v, (str, int, bool)):
        return str(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    return cols, sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def differences(a, b, limit=5):
    """Human-readable differences; empty when equal."""
    (ca, ra), (cb, rb) = a, b
    if ca != cb:
        return [f"columns {sorted(set(ca) ^ set(cb))}"]
    if len(ra) != len(rb):
        sa, sb = set(ra), set(rb)
        return [f"rows {len(ra)} vs {len(rb)}", f"cols {ca}", f"spark only {list(sa - sb)[:2]}", f"oracle only {list(sb - sa)[:2]}"]
    if ra == rb:
        return []
    sa, sb = set(ra), set(rb)
    only_a, only_b = sorted(sa - sb, key=repr), sorted(sb - sa, key=repr)
    out = [f"{len(only_a)}/{len(ra)} rows differ", f"cols {ca}"]
    out += [f"  spark  {x}\n  oracle {y}" for x, y in list(zip(only_a, only_b))[:limit]]
    return out


def main() -> int:
    from tickloom.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(p) for p in args):
            continue
        t0 = time.time()
        try:
            got = spark_rows(fn(spark, sf_dir))
            t1 = time.time()
            if name not in oracles:
                print(f"rows-only {name}: {len(got[1])} rows {t1 - t0:.1f}s", flush=True)
                continue
            diff = differences(got, oracle_rows(con, oracles[name]))
        except Exception as e:  # report and go on
            diff, t1 = [f"{type(e).__name__}: {str(e)[:1500]}"], time.time()
            got = (None, [])
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name}: {len(got[1])} rows {t1 - t0:.1f}s (+{time.time() - t1:.1f}s oracle)", flush=True)
        for line in diff:
            print("   ", line, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
