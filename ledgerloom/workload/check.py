"""Side-by-side check of registered queries against their SQL in DuckDB."""

from __future__ import annotations

import argparse
import math
import time

import duckdb
from pyspark.sql import SparkSession

from ledgerloom.session import build_session
from ledgerloom.workload import load

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v


_SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark: SparkSession, con, folder: str, name: str) -> tuple[str, float, float]:
    queries, oracles = load()
    t0 = time.time()
    df = queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in oracles:
        return f"rows-only {len(got)}", t1 - t0, 0.0
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {df.columns} vs {names}", t1 - t0, t2 - t1
    kinds = dict(zip(names, types, strict=True))
    off = [(c, t, kinds[c]) for c, t in df.dtypes if _SAME.get(t) != kinds[c]]
    order = [names.index(c) for c in df.columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    a = sorted((tuple(_norm(v) for v in r) for r in got), key=key)
    b = sorted((tuple(_norm(r[i]) for i in order) for r in want), key=key)
    if len(a) != len(b):
        miss = [x for x in b if x not in set(a)][:2]
        extra = [x for x in a if x not in set(b)][:2]
        return f"ROWS {len(a)} vs {len(b)} missing={miss} extra={extra}", t1 - t0, t2 - t1
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"VALUES {len(bad)} of {len(a)} {df.columns} e.g. {bad[0]}", t1 - t0, t2 - t1
    if off:
        return f"TYPES {off}", t1 - t0, t2 - t1
    return f"ok {len(a)}", t1 - t0, t2 - t1


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, _ = load()
    failed = 0
    for name in queries:
        if args.names and not any(name == n or name.startswith(n + "_") for n in args.names):
            continue
        try:
            told, s, d = compare(spark, con, args.sf, name)
        except Exception as e:  # noqa: BLE001
            told, s, d = f"ERROR {type(e).__name__} {str(e)[:600]}", 0.0, 0.0
        good = told.startswith(("ok", "rows-only"))
        failed += not good
        print(f"{'  ' if good else '!!'} {name:40s} {s:6.2f}s {d:6.2f}s {told}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
