"""Point-in-time windows and the bootstrap's products against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, inference

START = dt.datetime(2023, 11, 3, 7)
WINDOWS = {"hour": 3600, "day": 86400, "week": 7 * 86400, "own": None}


def plain(rows, prices):
    out = {}
    for contract, horizon, at, own in rows:
        mine = sorted((t for t in prices if t[1] == contract and t[2] <= at), key=lambda t: (t[2], t[0]))
        if not mine:
            continue
        found = {}
        for name, seconds in (*WINDOWS.items(), ("history", 10**9)):
            part = [t for t in mine if t[2] >= at - dt.timedelta(seconds=own if seconds is None else seconds)]
            p = [t[3] for t in part]
            found[name] = part and (len(part), sum(t[5] for t in part), sum(t[3] * t[5] for t in part), np.std(p, ddof=1) if len(p) > 1 else None, part[0][0], part[-1][0])
        out[contract, horizon] = found
    return out


def check(spark, rows, prices):
    left = spark.createDataFrame(rows, "contract_id string, horizon string, forecast_ts timestamp_ntz, own int").repartition(3)
    right = spark.createDataFrame(prices, "trade_id long, contract_id string, source_ts timestamp_ntz, price double, cents long, volume long").repartition(5)
    states = asof.window_states(left, right, {w: F.col("own") if s is None else s for w, s in WINDOWS.items()})
    got = states.select("*", *[asof.deviation(w).alias(f"sd_{w}") for w in (*WINDOWS, "history")]).collect()
    want = plain(rows, prices)
    assert {(r.contract_id, r.horizon) for r in got} == set(want)
    for r in got:
        for name, x in want[r.contract_id, r.horizon].items():
            state = r[name]
            assert (state is None) == (not x), (name, x)
            if x:
                assert (state["n"], state["volume"], state["first"]["trade_id"], state["last"]["trade_id"]) == (x[0], x[1], x[4], x[5])
                assert state["money"] == pytest.approx(x[2]) and (r[f"sd_{name}"] == pytest.approx(x[3], abs=1e-12) if x[3] is not None else r[f"sd_{name}"] is None)
    return states


def test_windows_with_a_contract_of_most_trades(spark):
    rng = random.Random(1)
    moment = lambda days: START + dt.timedelta(seconds=rng.randrange(int(days * 86400)))
    prices = [(k, "hot" if k % 10 else f"c{k % 7}", moment(300), rng.randint(1, 99) / 100, 1, rng.randint(1, 9)) for k in range(3000)]
    prices += [(5000 + k, "hot", START + dt.timedelta(days=40), 0.5, 50, 1) for k in range(40)]  # one time, many trades
    prices += [(6000, "one", START, 0.3, 30, 2), (6001, "edge", START - dt.timedelta(hours=7), 0.1, 10, 1), (6002, "edge", START + dt.timedelta(hours=17), 0.2, 20, 1)]
    rows = [(c, f"h{k}", moment(320), rng.choice([60, 90_000, 40 * 86400])) for c in ("hot", "c0", "c3", "one", "none") for k in range(12)]
    rows += [("hot", "at", START + dt.timedelta(days=40), 60), ("hot", "before", START - dt.timedelta(days=2), 60), ("one", "equal", START, 0), ("one", "late", START + dt.timedelta(days=4000), 60)]
    # Windows that begin exactly at a trade, at midnight, and end within the first day.
    rows += [("edge", "day", START + dt.timedelta(hours=17), 86400), ("edge", "midnight", START + dt.timedelta(hours=16, seconds=3599), 3600)]
    states = check(spark, rows, prices)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_row_meets_its_history(spark):
    """The join with the trades makes a row for each trade of a boundary day at most."""
    prices = spark.range(20_000).selectExpr("id AS trade_id", "'hot' AS contract_id", "timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT) * 10) AS source_ts", "0.5D AS price", "50L AS cents", "1L AS volume")
    rows = spark.range(200).selectExpr("'hot' AS contract_id", "CAST(id AS STRING) AS horizon", "timestamp_ntz'2023-06-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS forecast_ts")
    states = asof.window_states(rows, prices, {"day": 86400}).collect()
    assert len(states) == 200 and all(r.history["n"] == min(20_000, r.history["n"]) and r.history["moments"]["m2"] < 1e-12 for r in states)
    assert all(r.history["n"] == 20_000 for r in states)


def test_empty_tables(spark):
    rows = spark.createDataFrame([("a", "h", START)], "contract_id string, horizon string, forecast_ts timestamp_ntz")
    prices = spark.createDataFrame([], "trade_id long, contract_id string, source_ts timestamp_ntz, price double, cents long, volume long")
    assert asof.window_states(rows, prices, {"day": 86400}).collect() == [] and asof.window_states(rows.limit(0), prices, {"day": 86400}).collect() == []


def test_weights_are_those_of_the_expression(spark):
    names = ["a", "F7", "é", "", "x|y"]
    drawn = {(r.cluster, r.replicate): r.w for r in inference.draws(spark.createDataFrame([(n,) for n in names], "cluster string"), 700).collect()}
    made = inference._weights(names, 256, 700)
    assert all(made[k, r - 256] == drawn[n, r] for k, n in enumerate(names) for r in range(256, 700))


@pytest.mark.parametrize("chunk", [256, 2])
def test_products_are_weighted_sums(spark, monkeypatch, chunk):
    """Many tasks, groups that share clusters, a cluster of most rows, and a group that a replicate draws nothing of."""
    monkeypatch.setattr(inference, "CHUNK", chunk)
    monkeypatch.setattr(inference, "SLAB", 40)
    monkeypatch.setattr(inference, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    rows = [("m", "g", f"k{g}", f"c{c}", b, float(n), float(n) * 0.4, float(n) * rng.random()) for g in range(3) for c in range(2 if g == 2 else 23) for b in range(4) for n in [10_000 if c == 0 else int(rng.integers(1, 9))]]
    schema = "model_name string, grouping_name string, group_key string, cluster string, bin int, n double, sp double, sy double"
    cells = spark.createDataFrame(rows, schema).repartition(7)
    got = {(r.group_key, r.replicate): r.ece for r in inference.bootstrap_ece(cells, 100).collect()}
    assert len(got) == 300
    names = sorted({r[3] for r in rows})
    w = dict(zip(names, inference._weights(names, 0, 100), strict=True))
    for key in ("k0", "k1", "k2"):
        mine = [r for r in rows if r[2] == key]
        total = sum(w[r[3]] * r[5] for r in mine)
        gap = sum(np.abs(sum(w[r[3]] * (r[6] - r[7]) for r in mine if r[4] == b)) for b in range(4))
        for k in range(100):
            assert got[key, k] is None if total[k] == 0 else got[key, k] == pytest.approx(gap[k] / total[k])
    assert any(v is None for v in got.values())
