"""The bootstrap's products: each row of the statistics is shuffled once, and sums that are handed on early are the same."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, metrics

GROUPINGS = {"overall": [], "h": ["h"]}


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    plain = spark.range(3000).select(
        F.element_at(F.array(F.lit("raw"), F.lit("x")), (k % 2 + 1).cast("int")).alias("model_name"), F.when(k % 13 != 0, F.concat(F.lit("f"), k * k % 71)).alias("event_family_id"), F.concat(F.lit("h"), k % 3).alias("h"), (k * 37 % 1000 / 1000.0).alias("p"), (k * 7 % 11 < 5).cast("int").alias("y")
    )
    return plain.withColumnsRenamed({"p": "predicted_probability", "y": "observed_outcome"})


def cells_of(df):
    return sorted(((r.model_name, r.grouping_name, r.group_key, r.cluster or "", r.bin, r.n, round(r.sp, 9), r.sy) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [1 << 20, 60, 1])
def test_cells_of_small_and_large_clusters(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(inference, "MAX_CLUSTER_ROWS", limit)
    assert cells_of(inference.bin_stats(rows, groupings=GROUPINGS)) == cells_of(inference.bin_stats(metrics.by_groupings(rows, GROUPINGS)))


def test_rows_are_not_repeated_by_replicates(spark, rows):
    found = inference.bootstrap_ece(inference.bin_stats(rows, groupings=GROUPINGS), 1000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # One by grouping, one of the finished matrices: none by slabs of replicates.
    assert plan.count("Generate ") == 2


@pytest.mark.parametrize("held", [128 << 20, 1])
def test_sums_handed_on_early(spark, rows, monkeypatch, held):
    want = {r[:4]: r.ece for r in inference.bootstrap_ece(inference.bin_stats(rows, groupings=GROUPINGS), 70).collect()}
    monkeypatch.setattr(inference, "HELD_BYTES", held)
    monkeypatch.setattr(inference, "CHUNK", 3)
    monkeypatch.setattr(inference, "SLAB", 32)
    got = {r[:4]: r.ece for r in inference.bootstrap_ece(inference.bin_stats(rows, groupings=GROUPINGS).repartition(9), 70).collect()}
    assert len(want) == 2 * 4 * 70 and set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_fits_are_broadcast(spark, rows):
    """The rows of a group don't meet in the task of its fit."""
    grouped = metrics.by_groupings(rows, GROUPINGS)
    fits = spark.createDataFrame([(m, "overall", "all", 0.1, 1.0) for m in ("raw", "x")], "model_name string, grouping_name string, group_key string, intercept double, slope double")
    assert "SortMergeJoin" not in inference.cluster_scores(grouped, fits)._jdf.queryExecution().executedPlan().toString()
