"""Point-in-time snapshots of candidates (contract by horizon).

The last trade, the window averages and all counts come from the states of contract days that
:mod:`tidemark.operators.asof` merges; no candidate meets its contract's history. Nothing is broadcast but the horizon
list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import outcome_number, parse_duration, plus_seconds, seconds_between
from tidemark.operators.asof import HISTORY, KEYS, window_states


@dataclass(frozen=True)
class Horizon:
    """A horizon with its own policy: how old a last trade may be, and the averaging window."""

    name: str
    max_staleness: str = "7d"
    vwap_window: str = "6h"
    prefer_vwap: bool = False


# The default policy of each horizon.
HORIZONS = (
    Horizon("30d", "7d", "6h"), Horizon("14d", "7d", "6h"), Horizon("7d", "7d", "6h"), Horizon("3d", "3d", "6h"), Horizon("1d", "1d", "1h"),
    Horizon("6h", "6h", "15m"), Horizon("1h", "1h", "5m"), Horizon("15m", "15m", "5m"), Horizon("close", "5m", "5m"),
)


def override(horizons: tuple[Horizon, ...], max_staleness: str | None = None, vwap_window: str | None = None, prefer_vwap: bool | None = None) -> tuple[Horizon, ...]:
    """One policy for all horizons: any override clears every horizon's own policy, and what isn't given takes the default."""
    if max_staleness is None and vwap_window is None and prefer_vwap is None:
        return horizons
    base = Horizon("")
    return tuple(Horizon(h.name, max_staleness or base.max_staleness, vwap_window or base.vwap_window, base.prefer_vwap if prefer_vwap is None else prefer_vwap) for h in horizons)


def candidates(contracts: DataFrame, horizons: tuple[Horizon, ...] = HORIZONS) -> DataFrame:
    """Each contract at each horizon, with forecast_ts = resolution_ts - horizon and the horizon's policy."""
    return variant_candidates(contracts, {"": horizons}).drop("variant")


def variant_candidates(contracts: DataFrame, variants: dict[str, tuple[Horizon, ...]]) -> DataFrame:
    """:func:`candidates` of each variant (a name and its policies), with a column variant; but for the empty name, ``horizon`` has it before the horizon's own name and a bar."""
    rows = [(v, f"{v}|{h.name}" if v else h.name, parse_duration(h.name), parse_duration(h.max_staleness), parse_duration(h.vwap_window), h.prefer_vwap) for v, horizons in variants.items() for h in horizons]
    grid = contracts.sparkSession.createDataFrame(rows, "variant string, horizon string, horizon_seconds long, max_staleness long, vwap_window long, prefer_vwap boolean")
    every = contracts.select("contract_id", "event_id", "outcome", "close_time", "resolution_ts").crossJoin(F.broadcast(grid))  # variants x horizons, as many as were named
    return every.withColumn("forecast_ts", plus_seconds(F.col("resolution_ts"), -F.col("horizon_seconds")))


#: The averaging window of a candidate's policy.
VWAP = "vwap"


def window_sums() -> list[Column]:
    """Columns of :func:`window_states`: last (the last trade up to the forecast, ties to the largest trade_id) and the sums of the averaging window."""
    of = F.col(VWAP)
    return [F.col(HISTORY)["last"].alias("last"), of["money"].alias("vwap_money"), of["volume"].alias("vwap_volume"), of["n"].alias("vwap_trade_count"), of["last"]["source_ts"].alias("vwap_ts")]


def snapshot_stats(every: DataFrame, prices: DataFrame, windows: dict[str, int] | None = None, more: tuple[Column, ...] = (), how: str = "left") -> DataFrame:
    """Candidates with last (struct source_ts, trade_id, price, cents, volume) and the averaging window's sums, and ``more`` columns over further ``windows``. Candidates without a price stay, unless ``how`` is inner."""
    states = window_states(every, prices, {VWAP: F.col("vwap_window"), **(windows or {})})
    return every.join(states.select(*KEYS, *window_sums(), *more), KEYS, how)


def snapshot_panel(contracts: DataFrame, prices: DataFrame, horizons: tuple[Horizon, ...] = HORIZONS) -> DataFrame:
    """One row per candidate whose last trade is no older than its horizon allows; the price is the window average where preferred and there, else the last trade."""
    return panel_of(snapshot_stats(candidates(contracts, horizons), prices, how="inner"))


def panel_of(stats: DataFrame, *more: str) -> DataFrame:
    """The panel's rows and columns from candidates with their sums, and ``more`` of their columns."""
    fresh = stats.where(F.col("last.source_ts") >= plus_seconds(F.col("forecast_ts"), -F.col("max_staleness")))
    vwap = F.col("vwap_money") / F.nullif(F.col("vwap_volume"), F.lit(0))
    use = F.col("prefer_vwap") & F.col("vwap_trade_count").isNotNull()
    return fresh.select(
        "contract_id", "event_id", "outcome", outcome_number(F.col("outcome")).alias("observed_outcome"), "horizon", "horizon_seconds", "forecast_ts", "close_time", "resolution_ts",
        F.when(use, vwap).otherwise(F.col("last.price")).alias("snapshot_price"),
        F.when(use, "vwap").otherwise("last_trade").alias("snapshot_method"),
        F.when(use, F.col("vwap_ts")).otherwise(F.col("last.source_ts")).alias("price_timestamp"),
        seconds_between(F.when(use, F.col("vwap_ts")).otherwise(F.col("last.source_ts")), F.col("forecast_ts")).alias("staleness_seconds"),
        F.col("last.price").alias("last_trade_price"), F.col("last.source_ts").alias("last_trade_ts"),
        seconds_between(F.col("last.source_ts"), F.col("forecast_ts")).alias("last_trade_staleness"),
        vwap.alias("vwap_price"), "vwap_trade_count", "vwap_volume", "vwap_ts", *more,
    )


def drop_counts(contracts: DataFrame, prices: DataFrame, horizons: tuple[Horizon, ...] = HORIZONS) -> DataFrame:
    """horizon, candidates, no_price, stale, kept."""
    stats = snapshot_stats(candidates(contracts, horizons), prices)
    old = F.col("last.source_ts") < plus_seconds(F.col("forecast_ts"), -F.col("max_staleness"))
    return stats.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("last").isNull()).alias("no_price"), F.count_if(old).alias("stale"), F.count_if(~old).alias("kept")
    )


REQUIRED = ("contract_id", "horizon", "forecast_ts", "resolution_ts", "snapshot_price", "snapshot_method", "price_timestamp", "last_trade_ts")


def invariants(panel: DataFrame) -> DataFrame:
    """One row of violation counts: order of times, looking ahead (three ways), duplicate keys, missing prices."""
    look = lambda c: F.count_if(F.col(c) > F.col("forecast_ts"))
    return panel.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~(F.col("forecast_ts") < F.col("resolution_ts"))).alias("bad_order"),
        look("price_timestamp").alias("future_price"), look("last_trade_ts").alias("future_last_trade"), look("vwap_ts").alias("future_vwap"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct("contract_id", "horizon"))).alias("duplicate_keys"),
        F.count_if(F.col("snapshot_price").isNull() | ~F.col("snapshot_price").between(0, 1)).alias("bad_price"),
    )


def validate(panel: DataFrame) -> int:
    """Rows of a sound panel; raises on missing columns or any violation."""
    missing = [c for c in REQUIRED if c not in panel.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    found = invariants(panel if "vwap_ts" in panel.columns else panel.withColumn("vwap_ts", F.lit(None).cast("timestamp_ntz"))).first().asDict()
    rows = found.pop("row_count")
    if bad := {k: v for k, v in found.items() if v}:
        raise ValueError(f"invalid snapshot panel: {bad}")
    return rows
