"""Diagnostics of the raw prices and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import brier, elapsed_seconds, seconds_between
from tidemark.operators.asof import HISTORY, window_states
from tidemark.operators.quantiles import with_percentiles
from tidemark.session import materialize


def staleness_table(panel: DataFrame, column: str = "staleness_seconds", by: str = "horizon_name", limits: tuple[int, ...] = (300, 1800, 3600)) -> DataFrame:
    """Exact percentiles (linear) and the shares above limits."""
    points = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    above = [F.count_if(F.col(column) > x).alias(f"__above_{x}") for x in limits]
    found = with_percentiles(panel.where(F.col(column).isNotNull()), [by], column, points, F.count(F.lit(1)).alias("row_count"), *above)
    return found.select(by, "row_count", *points, *[(F.col(f"__above_{x}") / F.col("row_count")).alias(f"share_above_{x}") for x in limits])


def method_mix(panel: DataFrame, by: str = "horizon_name") -> DataFrame:
    """Rows and share of each snapshot method within a horizon."""
    counts = panel.groupBy(by, "snapshot_method").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def orientation(panel: DataFrame, p: str = "raw_probability") -> DataFrame:
    """Range and mean of the probability by outcome, and values out of range."""
    x = F.col(p)
    return panel.groupBy("observed_outcome").agg(F.count(F.lit(1)).alias("row_count"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.count_if(x.isNull() | ~x.between(0, 1)).alias("bad"))


def resolution_gaps(panel: DataFrame, by: str = "horizon_name") -> DataFrame:
    """Percentiles of the time from forecast to resolution, and the share within a day."""
    gap = elapsed_seconds(F.col("forecast_ts"), F.col("resolution_ts"))
    sums = [F.count("gap").alias("__n"), F.count_if(F.col("gap") <= 86400).alias("__within")]
    found = with_percentiles(panel.withColumn("gap", gap), [by], "gap", {"median_gap": 0.5, "p90_gap": 0.9}, *sums)
    return found.select(by, "median_gap", "p90_gap", (F.col("__within") / F.nullif(F.col("__n"), F.lit(0))).alias("share_within_day"))


def balanced(panel: DataFrame, by: str = "horizon") -> DataFrame:
    """The rows of contracts that have every horizon of the panel."""
    n = panel.agg(F.count_distinct(by).alias("n"))
    whole = panel.groupBy("contract_id").agg(F.count_distinct(by).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n"))
    return panel.join(whole.select("contract_id"), "contract_id", "left_semi")


def stale_flags(panel: DataFrame, limit: int = 3000) -> DataFrame:
    """Rows above the limit, the stalest first."""
    return panel.where(F.col("staleness_seconds") > limit).orderBy(F.col("staleness_seconds").desc(), "row_id")


def strict_variants(candidates: DataFrame, prices: DataFrame, stale: tuple[int, ...] = (600, 3600, 21600, 86400, 259200), windows: tuple[int, ...] = (3600, 21600, 86400, 172800)) -> DataFrame:
    """Per horizon, staleness limit and method (last_trade, or a window average): rows and mean Brier score of the snapshots that fit. All variants come from the same states of contract days."""
    states = window_states(candidates, prices, {f"w{w}": w for w in windows})
    sums = [x for w in windows for x in (F.col(f"w{w}.money").alias(f"m{w}"), F.col(f"w{w}.volume").alias(f"v{w}"))]
    rows = candidates.select("contract_id", "horizon", "outcome", "forecast_ts").join(states.select("contract_id", "horizon", F.col(HISTORY)["last"].alias("last"), *sums), ["contract_id", "horizon"])
    age = seconds_between(F.col("last.source_ts"), F.col("forecast_ts"))
    options = [F.struct(F.lit("last_trade").alias("method"), F.col("last.price").alias("p"))] + [F.struct(F.lit(f"vwap_{w}").alias("method"), (F.col(f"m{w}") / F.nullif(F.col(f"v{w}"), F.lit(0))).alias("p")) for w in windows]
    grid = rows.select("horizon", "outcome", age.alias("age"), F.explode(F.array(*options)).alias("o")).select("horizon", "outcome", "age", "o.*").withColumn("max_stale", F.explode(F.array(*map(F.lit, stale))))
    kept = grid.where((F.col("age") <= F.col("max_stale")) & F.col("p").isNotNull())
    y = F.when(F.col("outcome") == "yes", 1).otherwise(0)
    return kept.groupBy("horizon", "max_stale", "method").agg(F.count(F.lit(1)).alias("row_count"), F.avg(brier(F.col("p"), y)).alias("mean_brier"))


def close_semantics(panel: DataFrame, contracts: DataFrame, horizon: str = "close", flag_above: int = 300, limits: tuple[int, ...] = (60, 120, 240)) -> DataFrame:
    """Per snapshot method of the close horizon: rows, percentiles of the times from forecast, price and last trade to the resolution and to the contract's own times, and shares of stale or late prices."""
    own = contracts.select("contract_id", F.col("resolution_ts").alias("__end"), F.col("close_time").alias("__close"))
    mine = panel.where(F.col("horizon") == horizon).select("contract_id", "snapshot_method", "forecast_ts", "resolution_ts", "price_timestamp", "last_trade_ts", "staleness_seconds")
    rows = materialize(mine.join(own, "contract_id", "left"), "close-rows")  # several scans read it, and the panel is dear
    gap = lambda a, b: elapsed_seconds(F.col(a), F.col(b))
    share = lambda c: F.avg(c.cast("double"))
    stale = F.col("staleness_seconds")
    found = rows.groupBy("snapshot_method").agg(
        F.count(F.lit(1)).alias("row_count"), share(F.col("price_timestamp") < F.col("forecast_ts")).alias("share_price_before_forecast"), share(F.col("price_timestamp") == F.col("forecast_ts")).alias("share_price_at_forecast"),
        share(stale > flag_above).alias("share_flagged"), (F.count("__end") > 0).alias("contract_resolution_there"), share(F.col("resolution_ts") == F.col("__end")).alias("share_same_resolution"), (F.count("__close") > 0).alias("close_time_there"),
        *[share(stale > x).alias(f"share_above_{x}") for x in limits],
    )
    # All gaps are one column with the gap's name as a further key.
    gaps = {
        "to_forecast": gap("forecast_ts", "resolution_ts"), "to_price": gap("price_timestamp", "resolution_ts"), "to_last_trade": gap("last_trade_ts", "resolution_ts"),
        "contract_end_to_price": gap("price_timestamp", "__end"), "close_to_resolution": gap("__close", "resolution_ts"), "close_to_price": gap("price_timestamp", "__close"),
    }
    long = rows.select("snapshot_method", F.explode(F.array(*[F.struct(F.lit(n).alias("gap"), g.alias("seconds")) for n, g in gaps.items()])).alias("x")).select("snapshot_method", "x.*")
    each = with_percentiles(long, ["snapshot_method", "gap"], "seconds", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    wide = each.groupBy(F.col("snapshot_method").alias("__method")).agg(
        *[F.max(F.when(F.col("gap") == n, F.col("median"))).alias(f"median_{n}") for n in gaps], *[F.max(F.when(F.col("gap") == "to_price", F.col(p))).alias(f"{p}_to_price") for p in ("p90", "p95", "p99")]
    )
    return found.join(wide, F.col("snapshot_method").eqNullSafe(F.col("__method")), "left").drop("__method")
