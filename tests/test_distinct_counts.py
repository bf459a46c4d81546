"""Distinct contracts and families by group, null ids among them."""

from pyspark.sql import functions as F

from tidemark.operators import metrics

GROUPINGS = {"overall": [], "h": ["h"], "h_d": ["h", "d"]}


def test_as_the_grouped_rows_have_it(spark):
    k = F.col("id")
    rows = spark.range(500).select(
        F.when((k % 7 != 0) & (k % 3 != 2), F.concat(F.lit("c"), k % 41)).alias("contract_id"), F.when(k % 5 != 0, F.concat(F.lit("f"), k % 13)).alias("event_family_id"), F.concat(F.lit("h"), k % 3).alias("h"), F.when(k % 4 != 0, F.concat(F.lit("d"), k % 4)).alias("d"),
        (k % 100 / 100.0).alias("raw_probability"), (k % 2).cast("int").alias("observed_outcome"),
    )
    scored = metrics.scored(rows)
    plain = metrics.metric_table(metrics.by_groupings(scored, GROUPINGS))
    found = metrics.metric_table(scored, groupings=GROUPINGS)
    assert found.columns == plain.columns
    as_rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert as_rows(found) == as_rows(plain) and len(as_rows(found)) == 16
    # No row is expanded for a distinct count.
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.group_key: r.contracts for r in found.collect() if r.grouping_name == "h"}["h2"] == 0
