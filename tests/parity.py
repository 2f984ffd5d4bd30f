"""Run registered queries on Spark and their SQL in DuckDB and compare the rows.

    python tests/parity.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = "/root/testdata"


def duck(sf_dir: str):
    import duckdb

    from atril.plans.views import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} rows {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = table(cols, cur.fetchall())
    t2 = time.time()
    info = f"{len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols} {info}"
    if got == want:
        return True, info + ("  EMPTY" if not got else "")
    gs, ws = set(map(repr, got)), set(map(repr, want))
    lines = [info + f" want {len(want)}"]
    lines += ["   spark only: " + x[:300] for x in sorted(gs - ws)[:3]]
    lines += ["   duck  only: " + x[:300] for x in sorted(ws - gs)[:3]]
    return False, "\n".join(lines)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    from pyspark.sql import SparkSession

    from atril.plans import registry

    registry.load()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{TESTDATA}/sf{args.sf}"
    con = duck(sf_dir)
    keys = [k for k in registry.QUERIES if not args.keys or any(k.startswith(p) for p in args.keys)]
    bad = []
    for k in keys:
        try:
            ok, info = compare(spark, con, k, registry.QUERIES[k], registry.ORACLES.get(k), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(("ok  " if ok else "FAIL"), k, info, flush=True)
        if not ok:
            bad.append(k)
    print(f"{len(keys) - len(bad)}/{len(keys)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
