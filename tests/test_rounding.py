"""Doubles are rounded as the SQL beside them does it, on whole and half digits, of any size."""

import random

import duckdb
from pyspark.sql import functions as F

from tidemark import catalog


def test_rounds_like_sql(spark):
    random.seed(3)
    values = [0.0, -0.0, 1e-300, -1e-300, 4e-10, 5e-10, -5e-10, 0.1234567885, -0.1234567895, 2.5e-9, 4503599.627370496, 4503599.6273704961, 9007199.254740993, 1e15, -1e300, 1.7e308, float("inf"), float("-inf"), float("nan"), None]
    values += [random.choice([1, -1]) * (random.randrange(10**k) + 0.5) / 1e9 for k in range(1, 16) for _ in range(400)] + [random.uniform(-1, 1) * 10**k for k in range(-10, 12) for _ in range(300)]
    got = [(r.i, r.x) for r in spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", (catalog.round9(F.col("v")) + F.lit(0.0)).alias("x")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = dict(con.execute("SELECT i, round(v, 9) + 0.0 FROM t").fetchall())
    assert [(values[i], x, want[i]) for i, x in got if repr(x) != repr(want[i])] == []
