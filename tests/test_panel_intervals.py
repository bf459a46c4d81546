"""Calibration intervals of a panel: neither repeated nor met once for each model, and the same as those of the rows under each model."""

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import calibration, inference, metrics

GROUPINGS = {"overall": [], "h": ["h"], "h_and_d": ["h", "d"]}


def models():
    return {"raw": F.col("p"), "flat": F.when(F.col("h") == "h0", 0.5).otherwise(F.col("p") * 0.5 + 0.2)}


@pytest.fixture(scope="module")
def panel(spark):
    """With clusters, values and probabilities that are null, a group of few rows and one that a model can't be fitted in."""
    k = F.col("id")
    h = F.when(k < 9, "few").when(k % 11 != 0, F.concat(F.lit("h"), k % 3))
    p = F.when(k % 101 != 0, (1 + k * 37 % 97) / 100.0)
    y = (k * 7919 % 1000 / 1000.0 < p * 0.7 + 0.1).cast("int")
    return spark.range(4000).select(F.when(k % 13 != 0, F.concat(F.lit("f"), k * k % 71)).alias("event_family_id"), h.alias("h"), F.when(k % 5 != 0, k % 2).alias("d"), p.alias("p"), F.when(k % 211 != 0, F.coalesce(y, F.lit(0))).alias("observed_outcome"))


def long_rows(panel):
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), p.alias("predicted_probability")) for m, p in models().items()]))
    return metrics.by_groupings(panel.withColumn("m", each).select("*", "m.*"), GROUPINGS)


def plain(r):
    return tuple(x and round(x, 9) if isinstance(x, float) else x for x in r)


def by_key(df):
    found = {plain(r)[:-3]: r[-3:] for r in df.collect()}
    return dict(sorted(found.items(), key=str))


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_as_of_rows_under_each_model(spark, panel, monkeypatch, limit):
    rows = long_rows(panel)
    data = calibration.compress(rows, inference.GROUP, p="predicted_probability")
    want = by_key(inference.calibration_intervals(rows, calibration.diagnostic(data, inference.GROUP), 200))
    monkeypatch.setattr(inference, "MAX_CLUSTER_ROWS", limit)
    got = by_key(inference.panel_intervals(panel, models(), GROUPINGS, 200))
    assert list(got) == list(want) and {k[5] for k in got} >= {"ok", "too_few_rows", "probability_has_no_variation"}
    for k, values in want.items():
        assert all(a is None and b is None or a == pytest.approx(b, rel=1e-9, abs=1e-9) for a, b in zip(got[k], values, strict=True)), k


def test_counts_of_the_panel(panel):
    columns = ["model_name", "grouping_name", "group_key", "p", "y", "n"]
    sort = lambda df: sorted((plain(r) for r in df.select(*columns).collect()), key=str)
    assert sort(calibration.compress_panel(panel, models(), GROUPINGS)) == sort(calibration.compress(long_rows(panel), inference.GROUP, p="predicted_probability"))


def test_marks_are_unique(spark, monkeypatch):
    """Under a salt that gives two groups one mark the next one is taken."""
    fits = spark.createDataFrame([("raw", "h", k, 0.0, 1.0) for k in ("a", "b", "c")], "model_name string, grouping_name string, group_key string, intercept double, slope double")
    hashed = inference._mark
    monkeypatch.setattr(inference, "_mark", lambda salt, name, key: F.when(key != "c", F.lit(7).cast("long")).otherwise(8) if salt == 0 else hashed(salt, name, key))
    groups, salt = inference.marked_groups(fits, {"raw": F.col("p")})
    assert salt == 1 and groups.select("group").distinct().count() == 3


def test_query_repeats_no_row_by_model(spark, monkeypatch):
    """Rows are shuffled to their cluster as the panel has them, and repeated there once, by grouping."""
    plans, write = {}, inference.materialize

    def spy(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(inference, "materialize", spy)
    assert catalog.queries()["d19_calibration_intervals"](spark, "/root/testdata/sf0.001").count() == 120
    lines = plans["cluster-scores"].splitlines()
    repeated, shuffled = ([k for k, line in enumerate(lines) if word in line] for word in ("Generate ", "RepartitionByExpression"))
    assert len(repeated) == len(shuffled) == 1 and repeated < shuffled
