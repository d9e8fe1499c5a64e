"""Run a query in Spark and its twin in DuckDB and report the first difference."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(text(r[i]) for i in order) for r in data)


def compare(spark, name, fn, sql, sf):
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {sorted(names)}, first {bad[0]}"
    return None if got else "no rows"


if __name__ == "__main__":
    import catalog
    from chronopanel.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    fails = 0
    for n, fn in catalog.QUERIES.items():
        if "sql" in wanted and n not in catalog.ORACLES:
            continue
        if wanted and "sql" not in wanted and not any(n == x or n.startswith(x + "_") or x == "all" for x in wanted):
            continue
        t0 = time.time()
        try:
            why = compare(spark, n, fn, catalog.ORACLES.get(n), sf)
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:1500]}"
        fails += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {n} {time.time() - t0:.1f}s {why or ''}", flush=True)
    print("failures:", fails)
