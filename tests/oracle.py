"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    return got, want


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    from creditloom.catalog import entries
    from creditloom.session import tune

    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    con = duck(sf_dir)
    failed = []
    for name, (fn, sql) in entries().items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            if sql is None:
                df = fn(spark, sf_dir)
                print(f"{name}: {df.count()} rows (no sql) {time.time() - t:.1f}s", flush=True)
                continue
            got, want = compare(spark, con, fn, sql, sf_dir)
            ok = got == want
            print(f"{name}: {'ok' if ok else 'DIFF'} {len(got[1])}/{len(want[1])} {time.time() - t:.1f}s", flush=True)
            if not ok:
                failed.append(name)
                print("   ", got[0], want[0])
                a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                print("    spark only", sorted(a - b)[:4])
                print("    sql only  ", sorted(b - a)[:4])
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
