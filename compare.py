"""Compare registered queries with their oracle SQL: ``python compare.py [prefix …]`` (SF_DIR names the tables)."""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

from fieldmill.checks import all_checks
from fieldmill.checks.base import TABLES, Tables
from fieldmill.session import build_session


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def main(prefixes):
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def connect():
        con = duckdb.connect()
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        return con

    con = connect()
    bad = 0
    for name, item in all_checks().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = item.run(Tables(spark, folder))
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if item.sql is None:
                print(f"rows  {name:34s} {len(got):7d} rows {took:6.2f}s")
                continue
            start = time.time()
            cur = con.execute(item.sql)
            names = [d[0] for d in cur.description]
            want = rows_of(names, cur.fetchall())
            sql_took = time.time() - start
            ok = sorted(df.columns) == sorted(names) and got == want
            print(f"{'ok   ' if ok else 'DIFF '} {name:34s} {len(got):7d} rows {took:6.2f}s  oracle {len(want)} {sql_took:5.2f}s")
            if not ok:
                bad += 1
                print("   columns", sorted(df.columns), sorted(names))
                a, b = set(got), set(want)
                for label, only in (("spark", a - b), ("oracle", b - a)):
                    for r in sorted(only, key=repr)[:2]:
                        print("   only", label, repr(r)[:700])
        except Exception as error:  # report and go on with the next query
            bad += 1
            con = connect()
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:600]}")
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
