"""Small tables for reports, made from metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import bin_index
from tidemark.operators.keys import join_checked
from tidemark.operators.metrics import metric_rows


def with_deltas(metrics: DataFrame, keys: list[str], value: str = "mean_brier", baseline: str = "raw") -> DataFrame:
    """metrics with delta, the difference to the baseline model in the same group."""
    raw = F.max(F.when(F.col("model_name") == baseline, F.col(value))).over(Window.partitionBy(*keys))
    return metrics.withColumn("delta", F.col(value) - raw)


def final_pnl(cumulative: DataFrame) -> DataFrame:
    """The last running total of each group."""
    return cumulative.groupBy("model_name", "friction_tier", "trade_side").agg(F.max_by("cumulative", F.struct("forecast_ts", "row_id")).alias("final"))


def horizon_model_pivot(rows: DataFrame, models: list[str], value: str = "brier") -> DataFrame:
    """A row per horizon and a column of mean scores per model."""
    return rows.groupBy("horizon_name").pivot("model_name", models).agg(F.avg(value))


def probability_histogram(panel: DataFrame, bins: int = 20, p: str = "raw_probability") -> DataFrame:
    return panel.groupBy("horizon_name", bin_index(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def domain_table(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Per domain: rows, calibration error, share of ambiguous and of low-confidence rows. errors: ece by domain."""
    shares = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("row_count"), F.avg(F.col("taxonomy_ambiguous").cast("double")).alias("ambiguous_share"), F.avg((F.col("taxonomy_confidence") == "low").cast("double")).alias("low_confidence_share"))
    return shares.join(errors, shares["domain"].eqNullSafe(errors["domain"]), "left").select(shares["*"], "ece")


def top_domains(panel: DataFrame, n: int = 6) -> DataFrame:
    found = panel.where("domain IS NOT NULL AND domain <> 'ambiguous'").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "domain").limit(n)


def in_order(table: DataFrame, column: str, order: list[str]) -> DataFrame:
    """table with ``place``, the column's rank in a given order."""
    ranks = table.sparkSession.createDataFrame([(x, k) for k, x in enumerate(order)], f"{column} string, place int")
    return table.join(F.broadcast(ranks), column, "left")


def status_roll_up(checks: DataFrame) -> DataFrame:
    """Per phase the counts of PASS, PARTIAL and FAIL, and the phase's own status: the worst of them."""
    n = lambda s: F.count_if(F.col("status") == s)
    found = checks.groupBy("phase").agg(n("PASS").alias("passed"), n("PARTIAL").alias("partial"), n("FAIL").alias("failed"))
    return found.withColumn("status", F.when(F.col("failed") > 0, "FAIL").when(F.col("partial") > 0, "PARTIAL").otherwise("PASS"))


def merge_reports(scores: DataFrame, *more: DataFrame, keys: tuple[str, ...] = ("model_name", "grouping_name", "group_key")) -> DataFrame:
    """scores with the columns of further report tables, each joined one to one on the keys; rows without a partner keep nulls. Raises if a table repeats a key."""
    out = scores
    for table in more:
        out = join_checked(out, table, list(keys), "1:1", complete=False)
    return out


def fit_row_recount(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """fold_id, model_name, fit_row_count, expected, agrees: what the predictions say their fit saw, against the recount by fold."""
    said = predictions.select("fold_id", "model_name", "fit_row_count").distinct()
    joined = said.join(expected.select("fold_id", F.col("n").alias("expected")), "fold_id", "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return joined.withColumn("agrees", F.col("fit_row_count") == F.col("expected"))


def method_mix_pivot(panel: DataFrame, methods: list[str], by: str = "horizon_name") -> DataFrame:
    """A row per horizon and the share of each snapshot method."""
    counts = panel.groupBy(by).pivot("snapshot_method", methods).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(m), F.lit(0)) for m in methods), F.lit(0))
    return counts.select(by, *[(F.coalesce(F.col(m), F.lit(0)) / total).alias(m) for m in methods])


def horizon_bin_pivot(panel: DataFrame, bins: int = 10, p: str = "raw_probability", y: str = "observed_outcome") -> DataFrame:
    """A row per horizon and the observed rate of each probability bin."""
    found = panel.withColumn("bin", bin_index(F.col(p), bins)).groupBy("horizon_name").pivot("bin", list(range(bins))).agg(F.avg(y))
    return found.select("horizon_name", *[F.col(str(k)).alias(f"bin_{k}") for k in range(bins)])


def report_order(table: DataFrame, count: str, *ties: str) -> DataFrame:
    """The table with the largest counts first."""
    return table.orderBy(F.desc(count), *ties)


def overall_scores(rows: DataFrame, order: list[str]) -> DataFrame:
    """model_name, place, row_count, mean_brier, mean_log_loss, ece and the differences to the baseline."""
    found = metric_rows(rows, ["model_name"]).select("model_name", "row_count", "mean_brier", "mean_log_loss", "ece")
    found = with_deltas(found, [], "mean_brier").withColumnRenamed("delta", "brier_delta")
    found = with_deltas(found, [], "mean_log_loss").withColumnRenamed("delta", "log_loss_delta")
    return in_order(found, "model_name", order)


def sample_table(panel: DataFrame) -> DataFrame:
    """One row on what the panel holds."""
    return panel.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("contract_id").alias("contracts"), F.count_distinct("event_family_id").alias("families"), F.count_distinct("domain").alias("domains"),
        F.min("forecast_ts").alias("first_ts"), F.max("forecast_ts").alias("last_ts"), F.avg("observed_outcome").alias("outcome_rate"),
    )


def edge_sensitivity(summary: DataFrame) -> DataFrame:
    """Selected candidates, simulated totals and mean edges by model and friction tier."""
    return summary.select("model_name", "friction_tier", "selected", F.col("selected_total").alias("simulated_total"), F.col("selected_mean_net_edge").alias("mean_net_edge"))
