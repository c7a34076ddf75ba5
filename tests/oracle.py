"""Holds queries against their DuckDB SQL: python tests/oracle.py [sf_dir] [name...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    import datetime
    import decimal

    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def differences(spark, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    got = connect(sf_dir).execute(sql)
    names = [x[0] for x in got.description]
    theirs = rows_of(names, got.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}: {mine[1][:2]} / {theirs[1][:2]}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 2e-5) for x, y in zip(a, b))]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "5g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = e.oracle_sql(), 0
    for name, q in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:] or len(sys.argv) <= 2 and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            said = differences(spark, sf, name, q, sqls[name]) if name in sqls else f"- {q(spark, sf).count()} rows, no SQL"
        except Exception as x:
            said = f"ERROR {str(x)[:600]}"
        bad += bool(said) and not said.startswith("-")
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bool(bad))
