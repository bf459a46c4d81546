"""Contracts are counted where their rows meet."""

import datetime as dt

from tidemark.operators import folds


def test_rows_meet_before_they_are_counted(spark):
    rows = [(f"c{k % 40}" if k % 11 else None, dt.datetime(2024, 1 + k % 7, 1 + k % 28)) for k in range(900)]
    panel = spark.createDataFrame(rows, "contract_id string, forecast_ts timestamp_ntz")
    made = folds.make_folds(panel)
    found = folds.split_counts(panel, made)
    got = {(r.fold_id, r.split): (r.n, r.contracts) for r in found.collect()}
    plain = {}
    for r in folds.assign(panel, made).collect():
        cell = plain.setdefault((r.fold_id, r.split), [0, set()])
        cell[0] += 1
        cell[1].add(r.contract_id)
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in plain.items()}
    assert "RepartitionByExpression [contract_id" in found._jdf.queryExecution().optimizedPlan().toString()
