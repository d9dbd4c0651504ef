"""Compares queries with their SQL in DuckDB: python tests/oracle.py SF [NAME...]"""

import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    order = sorted(range(len(found[0])), key=lambda i: found[0][i])
    return [found[0][i] for i in order], sorted(str([str(r[i]) if r[i] is None or isinstance(r[i], (str, bool)) else float(r[i]) if hasattr(r[i], "__float__") else str(r[i]) for i in order]) for r in found[1])


def by_duckdb(sf, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(sql)
    return rows(([x[0] for x in r.description], r.fetchall()))


def by_spark(spark, sf, f):
    df = f(spark, sf)
    return rows((df.columns, [tuple(r) for r in df.collect()]))


if __name__ == "__main__":
    import __spark_entry__ as E
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
    for name, f in E.queries().items():
        if (names and not any(name.startswith(n) for n in names)) or (not names and name not in E.oracle_sql()):
            continue
        t = time.time()
        try:
            got = by_spark(spark, sf, f)
            took = time.time() - t
            want = by_duckdb(sf, E.oracle_sql()[name])
            ok = got == want
            print("ok  " if ok else "DIFF", name, len(got[1]), len(want[1]), f"{took:.1f} s", flush=True)
            if not ok:
                a, b = set(got[1]), set(want[1])
                print("   ", got[0], want[0], "\n    spark", sorted(a - b)[:3], "\n    duck ", sorted(b - a)[:3])
        except Exception as e:
            print("FAIL", name, str(e)[:700].replace("\n", " "), traceback.format_exc().splitlines()[-4:-2])
