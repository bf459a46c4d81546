"""Running sums, last values and places over sorted ranges, and percentiles by selection, against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import edge, keys, quantiles, scan

T = dt.datetime(2024, 1, 1)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_total_of_rows_at_one_time(spark, small_batches):
    """One group with nearly all rows, at one time, whose ids start alike; and null keys, which are a group."""
    rng = random.Random(1)
    rows = [("m", "t", "YES", T, f"same-prefix-{k:06d}", rng.random() - 0.5, True) for k in range(4000)] + [(None, "t", "YES", T, f"id{k}", 1.0, k % 2 == 0) for k in range(50)] + [("n", "t", "NO", T + dt.timedelta(days=k), "x", None if k == 3 else float(k), True) for k in range(9)]
    df = spark.createDataFrame(rows, "model_name string, friction_tier string, trade_side string, forecast_ts timestamp_ntz, row_id string, realized_total double, passes_threshold boolean").repartition(5)
    got = {(r.model_name, r.forecast_ts, r.row_id): r.cumulative for r in edge.cumulative_pnl(df).collect()}
    total, want = {}, {}
    for r in sorted((r for r in rows if r[6]), key=lambda r: (r[3], r[4])):
        total[r[0]] = total.get(r[0], 0.0) + (r[5] or 0.0)
        want[r[0], r[3], r[4]] = total[r[0]]
    assert set(got) == set(want) and all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())


def test_last_quotes_of_a_hot_contract(spark, small_batches):
    rng = random.Random(2)
    moment = lambda n: T + dt.timedelta(seconds=rng.randrange(n))
    quotes = [("hot" if k % 10 else f"c{k % 3}", moment(5000), rng.randint(1, 9) / 10, rng.randint(1, 9) / 10) for k in range(900)] + [("early", T, 0.1, 0.2)]
    rows = [(k, "hot" if k % 4 else rng.choice(["c0", "c1", "none", "early"]), moment(6000)) for k in range(3000)] + [(9000 + k, "hot", T + dt.timedelta(seconds=7000)) for k in range(2000)]  # one time, long after the last quote
    left = spark.createDataFrame(rows, "id long, contract_id string, forecast_ts timestamp_ntz").repartition(4)
    right = spark.createDataFrame(quotes, "contract_id string, quote_ts timestamp_ntz, yes_bid double, yes_ask double").repartition(3)
    got = {r.id: (r.quote_ts, r.yes_ask, r.yes_bid) for r in edge.asof_quotes(left, right).collect()}
    assert len(got) == len(rows)
    for k, contract, at in rows:
        mine = [(t, ask, bid) for c, t, bid, ask in quotes if c == contract and t <= at]
        assert got[k] == (max(mine) if mine else (None, None, None))
    assert edge.asof_quotes(left, right.limit(0)).where("quote_ts IS NOT NULL").count() == 0 and edge.asof_quotes(left.limit(0), right).count() == 0


def test_positions(spark, small_batches):
    df = spark.range(2500).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"), F.col("id").alias("c")).repartition(6)
    got = [r.position for r in keys.positions(df, ["a", "b", "c"]).orderBy("a", "b", "c").collect()]
    assert got == list(range(2500))
    assert keys.positions(df.limit(0), ["a"]).count() == 0


def test_sums_start_anew_with_each_key(spark, small_batches):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("at"), F.lit(1).alias("v"))
    got = scan.running_sum(df, ["k"], ["at"], "v", "n").collect()
    assert all(r.n == r.at // 50 + 1 for r in got)


@pytest.mark.parametrize("limits", [(1 << 20, 4096), (50, 3)])
def test_percentiles_by_selection(spark, monkeypatch, limits):
    """Also where cells must be cut again and again: close values, ties, both signs, infinite ends."""
    monkeypatch.setattr(quantiles, "MAX_CELL", limits[0])
    monkeypatch.setattr(quantiles, "CUTS", limits[1])
    rng = random.Random(4)
    data = {
        "near": [1 + rng.random() * 1e-9 for _ in range(700)], "both": [rng.gauss(0, 1) for _ in range(900)], "ties": [rng.choice([0.1, 0.2, 0.3]) for _ in range(801)], "wide": [math.copysign(10 ** rng.uniform(-12, 12), rng.random() - 0.5) for _ in range(600)],
        "ends": [-math.inf, 0.0, -0.0, 5.0, math.inf], "two": [1.0, 2.0], None: [7.0] * 300 + [8.0],
    }
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("near", None), ("none", None)], "k string, v double").repartition(4)
    points = {"low": 0.05, "middle": 0.5, "high": 0.9, "last": 1.0}
    got = {r.k: r for r in quantiles.with_percentiles(df, ["k"], "v", points, F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).collect()}
    assert set(got) == {*data, "none"} and got["none"].middle is None and got["near"].n == 701
    for k, x in data.items():
        for name, q in points.items():
            if k != "ends" or name == "middle":
                assert math.isclose(got[k][name], np.quantile(x, q), rel_tol=1e-12, abs_tol=1e-300), (k, name)
    assert got["ends"].last == math.inf
