"""Run catalogue queries and compare them with their SQL on DuckDB.

    python -m workbench.run_queries [--sf 0.01] [name ...]
"""
from __future__ import annotations

import argparse
import math
import time

import duckdb

from attestra.session import local_session
from workbench import catalog, oracle, workload


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "is_integer") and not isinstance(v, (int, float)):
        return float(v)
    return v


def compare(spark_rows, cols, con, sql) -> str:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    rows = cur.fetchall()
    if sorted(names) != sorted(cols):
        return f"COLUMNS spark={sorted(cols)} sql={sorted(names)}"
    order = sorted(cols)
    a = sorted((tuple(_norm(r[c]) for c in order) for r in spark_rows), key=repr)
    ix = {n: i for i, n in enumerate(names)}
    b = sorted((tuple(_norm(r[ix[c]]) for c in order) for r in rows), key=repr)
    if a == b:
        return "ok"
    bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"DIFF spark={len(a)} sql={len(b)} columns={order} first={bad}"


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/sf{a.sf}"
    con = duckdb.connect()
    for t in workload.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    sqls, bad = oracle.oracle_sql(), []
    for name, fn in catalog.QUERIES.items():
        if a.names and name not in a.names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, d)
            rows = df.collect()
            took = time.time() - t0
            res = compare(rows, df.columns, con, sqls[name]) if name in sqls else "rows-only"
        except Exception as e:      # report and go on: this is a checking tool
            took, rows, res = time.time() - t0, [], f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if res not in ("ok", "rows-only"):
            bad.append(name)
        print(f"{name:28s} {took:6.2f}s {len(rows):7d} {res[:1200]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
