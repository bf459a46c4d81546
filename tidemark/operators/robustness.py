"""Robustness re-runs: slices, filters, weightings, purges, exclusions, frictions. Empty results stay with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import bin_index, brier, log_loss
from tidemark.operators.edge import EdgeConfig, simulate, simulate_counts, tier_summary
from tidemark.operators.features import DAY, SUMS, trailing_sums
from tidemark.operators.folds import leakage
from tidemark.operators.metrics import full_rows, metric_rows
from tidemark.operators.snapshots import Horizon, panel_of, snapshot_stats, variant_candidates
from tidemark.session import materialize


def _metrics(rows: DataFrame, *keys: str, full: bool = False) -> DataFrame:
    """Means by ``keys``; with ``full`` the whole metric rows, the calibration fit's intercept, slope and status among them."""
    if full:
        return full_rows(rows, list(keys))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.avg("brier").alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss"))


def method_slices(rows: DataFrame, full: bool = False) -> DataFrame:
    return _metrics(rows, "model_name", "snapshot_method", full=full)


def filter_grid(rows: DataFrame, filters: dict[str, Column], full: bool = False) -> DataFrame:
    """Per model and filter: metrics of the rows it keeps; a filter that keeps none has status empty_after_filter. One pass for all filters."""
    names = list(filters)
    tagged = rows.withColumn("filter_name", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in filters.items()]))))
    models = rows.select("model_name").distinct().withColumn("filter_name", F.explode(F.array(*map(F.lit, names))))
    found = models.join(_metrics(tagged, "model_name", "filter_name", full=full), ["model_name", "filter_name"], "left")
    return found.withColumn("row_count", F.coalesce("row_count", F.lit(0))).withColumn("status", F.when(F.col("row_count") == 0, "empty_after_filter").otherwise("ok"))


def liquidity_filters(rows: DataFrame, minima: tuple[float, ...] = (0.0, 20000.0, 60000.0, 1e9), full: bool = False) -> DataFrame:
    return filter_grid(rows, {f"liquidity>={m:g}": F.col("liquidity") >= m for m in minima}, full)


def staleness_filters(rows: DataFrame, maxima: tuple[float, ...] = (3600.0, 1800.0, 600.0, -1.0), full: bool = False) -> DataFrame:
    return filter_grid(rows, {f"staleness<={m:g}": F.col("staleness_seconds") <= m for m in maxima}, full)


def weighting_sensitivity(rows: DataFrame, keys: list[str], bins: int = 10, min_count: int = 5, volume: str = "cumulative_volume") -> DataFrame:
    """Per group and weighting (equal_contract, equal_event_family: 1 / the family's rows in the group, trade_weighted: no weight below zero): row_count, total_weight, mean_brier, mean_log_loss, ece, sparse_bins, status. rows: with brier and log_loss.

    One scan and one aggregate by group, family and bin serve all three: a family's weight is known from its counts. Rows go to their family before they are counted, so that a task's table has few families; a family of many rows is split over tasks.
    """
    p, y, w = F.col("predicted_probability"), F.col("observed_outcome"), F.greatest(F.coalesce(F.col(volume).cast("double"), F.lit(0.0)), F.lit(0.0))
    terms = {"n": F.lit(1.0), "b": F.col("brier"), "l": F.col("log_loss"), "p": p, "y": y.cast("double")}
    near = rows.select(*keys, "event_family_id", "predicted_probability", "observed_outcome", "brier", "log_loss", volume).hint("rebalance", "event_family_id")
    # As a struct, since Spark would take the rows as dealt by family for good, and couldn't split a family's.
    cells = near.groupBy(*keys, F.struct("event_family_id").alias("family"), bin_index(p, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(x).alias(f"e_{k}") for k, x in terms.items()], *[F.sum(w * x).alias(f"t_{k}") for k, x in terms.items()]
    )
    size = F.sum("rows").over(Window.partitionBy(*keys, "family"))
    cells = cells.withColumn("size", size).withColumns({f"f_{k}": F.col(f"e_{k}") / F.col("size") for k in terms})
    by_bin = cells.groupBy(*keys, "bin").agg(F.sum("rows").alias("rows"), *[F.sum(f"{m}_{k}").alias(f"{m}_{k}") for m in "eft" for k in terms])
    modes = {"e": "equal_contract", "f": "equal_event_family", "t": "trade_weighted"}
    long = by_bin.select(*keys, "rows", F.explode(F.array(*[F.struct(F.lit(name).alias("weighting"), *[F.col(f"{m}_{k}").alias(k) for k in terms]) for m, name in modes.items()])).alias("x")).select(*keys, "rows", "x.*")
    total = F.nullif(F.sum("n"), F.lit(0.0))
    return long.groupBy(*keys, "weighting").agg(
        F.sum("rows").alias("row_count"), F.sum("n").alias("total_weight"), (F.sum("b") / total).alias("mean_brier"), (F.sum("l") / total).alias("mean_log_loss"), (F.sum(F.abs(F.col("p") - F.col("y"))) / total).alias("ece"),
        (F.count_if(F.col("rows") < min_count) + (F.lit(bins) - F.count(F.lit(1)) if min_count > 0 else F.lit(0))).alias("sparse_bins"), F.when(F.sum("n") > 0, "ok").otherwise("zero_total_weight").alias("status"),
    )


def purged(rows: DataFrame, panel: DataFrame, folds: DataFrame) -> DataFrame:
    """All test rows (variant all), and those whose event family is in no other split of their fold (variant purged). rows: with fold_id."""
    torn = leakage(panel, folds).where(F.col("splits").contains("test")).select("fold_id", "event_family_id")
    left = rows.join(torn, ["fold_id", "event_family_id"], "left_anti")
    return rows.withColumn("variant", F.lit("all")).unionByName(left.withColumn("variant", F.lit("purged")))


def family_purge(rows: DataFrame, panel: DataFrame, folds: DataFrame, full: bool = False) -> DataFrame:
    """Per model the metrics of both variants."""
    return _metrics(purged(rows, panel, folds), "model_name", "variant", full=full)


def domain_exclusions(rows: DataFrame, full: bool = False) -> DataFrame:
    """Per model and rule: metrics of the rows outside the excluded ones; a rule that excludes none is not_applicable."""
    rules = {
        "no_sports": F.col("is_sports"), "no_ambiguous": F.col("taxonomy_ambiguous"), "no_low_confidence": F.col("taxonomy_confidence") == "low",
        "no_unknown": F.coalesce(F.col("domain"), F.lit("unknown")) == "unknown", "no_politics": F.col("domain") == "politics",
    }
    rules["strict"] = rules["no_sports"] | rules["no_ambiguous"] | rules["no_low_confidence"]
    hit = {k: F.coalesce(c, F.lit(False)) for k, c in rules.items()}
    kept = filter_grid(rows, {k: ~c for k, c in hit.items()}, full)
    out = rows.groupBy("model_name").agg(*[F.count_if(c).alias(k) for k, c in hit.items()])
    out = out.select("model_name", F.explode(F.array(*[F.struct(F.lit(k).alias("filter_name"), F.col(k).alias("excluded")) for k in hit])).alias("x")).select("model_name", "x.*")
    return kept.drop("status").join(out, ["model_name", "filter_name"]).withColumn("status", F.when(F.col("excluded") == 0, "not_applicable").when(F.col("row_count") == 0, "empty_after_filter").otherwise("ok"))


def friction_scenarios(predictions: DataFrame, rates: tuple[float, ...] = (0.0, 0.05, 0.07, 0.1), edges: tuple[float, ...] = (0.01, 0.02)) -> DataFrame:
    """Tier summaries under each fee rate and threshold, from one scan: equal predictions are counted before rates and tiers repeat them. A scenario's rate replaces the schedule, which is what a scenario is for."""
    rows = simulate_counts(predictions, EdgeConfig(), rates)
    return tier_summary(rows, {x: F.col("net_edge") >= x for x in edges}, ("fee_rate",), "n").withColumnRenamed("scenario", "min_net_edge")


def full_slices(rows: DataFrame, filters: dict[str, Column], full: bool = False) -> DataFrame:
    """model_name, filter_name, the full metric rows of what each filter keeps, and a status; filters that keep nothing stay."""
    tagged = rows.withColumn("filter_name", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in filters.items()]))))
    every = rows.select("model_name").distinct().withColumn("filter_name", F.explode(F.array(*map(F.lit, filters))))
    found = every.join((full_rows if full else metric_rows)(tagged, ["model_name", "filter_name"]), ["model_name", "filter_name"], "left")
    return found.withColumn("row_count", F.coalesce("row_count", F.lit(0))).withColumn("status", F.when(F.col("row_count") == 0, "empty_after_filter").otherwise("computed"))


def variant_panels(contracts: DataFrame, prices: DataFrame, variants: dict[str, tuple[Horizon, ...]]) -> DataFrame:
    """The snapshot panels of all variants with their trailing sums, from one scan of the prices: days' states serve every policy, and the variant is a column (and part of horizon) from the candidates on."""
    stats = snapshot_stats(variant_candidates(contracts, variants), prices, {f"last_{s}": s for s in (DAY, 7 * DAY)}, tuple(trailing_sums()), "inner")
    return panel_of(stats, "variant", *SUMS)


def variant_runs(contracts: DataFrame, prices: DataFrame, variants: dict[str, tuple[Horizon, ...]]) -> DataFrame:
    """Per snapshot variant: candidates, panel rows, mean scores, calibration error, mean trailing volume, and the candidates and selections of the edge screen on the panel's own prices. The variant is a key of every stage, and the panels are made and written once."""
    panel = materialize(variant_panels(contracts, prices, variants), "variants")
    made = variant_candidates(contracts, variants).groupBy("variant").agg(F.count(F.lit(1)).alias("candidates"))
    p, y = F.col("snapshot_price"), F.col("observed_outcome")
    scored = panel.withColumns({"brier": brier(p, y), "log_loss": log_loss(p, y)})
    scores = metric_rows(scored, ["variant"], p="snapshot_price").select("variant", F.col("row_count").alias("panel_rows"), "mean_brier", "mean_log_loss", "ece")
    features = panel.groupBy("variant").agg(F.avg(F.coalesce("liquidity_volume", F.lit(0)).cast("double")).alias("mean_liquidity"))
    rows = panel.select(F.col("variant").alias("model_name"), F.concat_ws("|", "contract_id", "horizon").alias("row_id"), p.alias("raw_probability"), p.alias("predicted_probability"), y.alias("observed_outcome"), "forecast_ts", "resolution_ts")
    screen = simulate(rows).groupBy(F.col("model_name").alias("variant")).agg(F.count(F.lit(1)).alias("edge_candidates"), F.count_if("passes_threshold").alias("edge_selected"))
    found = made.join(scores, "variant", "left").join(features, "variant", "left").join(screen, "variant", "left")
    return found.na.fill(0, ["panel_rows", "edge_candidates", "edge_selected"])
