"""Weightings count rows where their families meet."""

from tidemark.operators import robustness


def test_weighting_deals_rows_by_family(spark):
    """A task counts few families, and a family's rows may be split: the rows are dealt before they are counted, and counted in two steps."""
    rows = spark.createDataFrame([("m", f"F{k % 7 if k % 2 else 0}", k % 10 / 10 + 0.05, k % 3 % 2, 0.2, 0.5, k % 5) for k in range(400)], "model_name string, event_family_id string, predicted_probability double, observed_outcome int, brier double, log_loss double, cumulative_volume long")
    found = robustness.weighting_sensitivity(rows, ["model_name"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and plan.index("partial_sum(brier") < plan.index("REBALANCE_PARTITIONS_BY_COL")
    got = {r.weighting: r for r in found.collect()}
    assert {k: r.row_count for k, r in got.items()} == dict.fromkeys(("equal_contract", "equal_event_family", "trade_weighted"), 400)
    assert abs(got["equal_event_family"].total_weight - 7) < 1e-9 and abs(got["trade_weighted"].total_weight - sum(k % 5 for k in range(400))) < 1e-9
