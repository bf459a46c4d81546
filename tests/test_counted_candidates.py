"""Candidates that are alike are one row with a count, and the summaries are those of all rows."""

from pyspark.sql import functions as F

from tidemark.operators import edge, quantiles, robustness
from tidemark.sources import adapters

SF = "/root/testdata/sf0.001"


def alike(a, b, keys):
    a, b = ({tuple(r[k] for k in keys): r for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and a
    for k, want in a.items():
        for x, y in zip(want, b[k], strict=True):
            assert x == y or abs(x - y) < 1e-9 * max(1, abs(x))


def test_percentiles_of_counted_values(spark):
    counted = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 2), ("a", None, 9), ("a", 2.5, 0), ("b", None, 1), ("b", 7.0, 1)], "k string, v double, n long")
    rows = counted.select("k", "v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).where("i <= n AND i > 0 AND n > 0")
    points = {"low": 0.1, "half": 0.5, "top": 0.9}
    alike(quantiles.with_percentiles(rows, ["k"], "v", points, F.count(F.lit(1)).alias("m")), quantiles.with_percentiles(counted, ["k"], "v", points, F.sum("n").alias("m"), weight="n"), ["k"])


def test_summaries_of_counted_candidates(spark):
    rows = adapters.predictions(spark, SF).withColumn("raw_probability", F.when(F.col("cumulative_volume") == 4, None).otherwise(F.col("raw_probability")))
    counted = edge.simulate_counts(rows)
    assert not any("lineitem" in f for f in counted.inputFiles()) and counted.count() < edge.simulate(rows).count()
    alike(edge.tier_summary(edge.simulate(rows)), edge.tier_summary(counted, weight="n"), ["model_name", "friction_tier", "trade_side"])
    rates, edges = (0.0, 0.07), (0.01, 0.02)
    want = edge.tier_summary(edge.simulate(rows, rates=rates), {x: F.col("net_edge") >= x for x in edges}, ("fee_rate",)).withColumnRenamed("scenario", "min_net_edge")
    alike(want, robustness.friction_scenarios(rows, rates, edges), ["model_name", "friction_tier", "trade_side", "fee_rate", "min_net_edge"])
