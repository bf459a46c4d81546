"""Trailing features of snapshot rows, from the states of contract days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import EPSILON, clip, logit, month
from tidemark.operators.asof import HISTORY, KEYS, deviation, window_states
from tidemark.operators.snapshots import HORIZONS, Horizon, candidates, panel_of, snapshot_stats

DAY = 86400


def _windows(*seconds: int) -> dict[str, int]:
    return {f"last_{s}": s for s in seconds}


def trailing_sums(momentum: int = DAY, volatility: int = DAY, liquidity: int = 7 * DAY) -> list[Column]:
    """Columns of :func:`window_states` over the three windows and the history."""
    of_m, of_v, of_l, all_ = (F.col(x) for x in (*(f"last_{s}" for s in (momentum, volatility, liquidity)), HISTORY))
    count = lambda x: F.coalesce(x["n"], F.lit(0))
    ts = lambda x: x["last"]["source_ts"]
    return [
        count(all_).alias("cumulative_count"), all_["volume"].alias("cumulative_volume"), ts(all_).alias("cumulative_ts"),
        count(of_m).alias("momentum_count"), ts(of_m).alias("momentum_ts"), of_m["last"]["price"].alias("last_price"), of_m["first"]["price"].alias("first_price"),
        count(of_v).alias("volatility_count"), deviation(f"last_{volatility}").alias("deviation"),
        count(of_l).alias("liquidity_count"), of_l["volume"].alias("liquidity_volume"), ts(of_l).alias("liquidity_ts"),
    ]


SUMS = ["cumulative_count", "cumulative_volume", "cumulative_ts", "momentum_count", "momentum_ts", "last_price", "first_price", "volatility_count", "deviation", "liquidity_count", "liquidity_volume", "liquidity_ts"]


def feature_panel(panel: DataFrame, prices: DataFrame, contracts: DataFrame, momentum: int = DAY, volatility: int = DAY, liquidity: int = 7 * DAY, epsilon: float = EPSILON) -> DataFrame:
    """A given ``panel`` (contract_id, horizon, forecast_ts, snapshot_price, price_timestamp, ...) with its features; rows without trades stay with zeros. Where the panel is made from the same prices, :func:`snapshots_with_features` reads them once for both."""
    states = window_states(panel, prices, _windows(momentum, volatility, liquidity))
    stats = states.select(*KEYS, *trailing_sums(momentum, volatility, liquidity))
    return _features(panel.join(stats, KEYS, "left"), contracts, panel.columns, epsilon)


def snapshots_with_features(contracts: DataFrame, prices: DataFrame, horizons: tuple[Horizon, ...] = HORIZONS, epsilon: float = EPSILON) -> DataFrame:
    """The snapshot panel with its features from the same states."""
    stats = snapshot_stats(candidates(contracts, horizons), prices, _windows(DAY, 7 * DAY), tuple(trailing_sums()), "inner")
    rows = panel_of(stats, *SUMS)
    return _features(rows, contracts, [c for c in rows.columns if c not in SUMS], epsilon)


def _features(rows: DataFrame, contracts: DataFrame, columns: list[str], epsilon: float) -> DataFrame:
    """columns and features: momentum (last minus first, from two trades on), volatility (sample deviation), liquidity, months and flags. rows: with SUMS."""
    facts = contracts.select("contract_id", "created_ts", "open_ts", F.col("volume").alias("contract_volume"), "open_interest")
    rows = rows.join(facts, "contract_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    p = clip(F.col("snapshot_price"), epsilon)
    return rows.select(
        *columns, p.alias("clipped_probability"), logit(p).alias("logit_probability"),
        *[zero(c).alias(c) for c in ("cumulative_count", "cumulative_volume", "liquidity_count", "liquidity_volume")],
        F.log(1.0 + zero("liquidity_volume")).alias("public_liquidity_proxy"),
        F.when(F.col("momentum_count") >= 2, F.col("last_price") - F.col("first_price")).alias("momentum"),
        F.when(F.col("volatility_count") >= 2, F.col("deviation")).alias("volatility"),
        month(F.col("forecast_ts")).alias("forecast_month"), month(F.col("open_ts")).alias("listing_month"),
        "contract_volume", "open_interest", F.col("created_ts").isNull().alias("created_missing"), F.col("open_ts").isNull().alias("open_missing"),
        F.col("contract_volume").isNull().alias("volume_missing"), F.col("open_interest").isNull().alias("open_interest_missing"), (F.coalesce("volatility_count", F.lit(0)) < 2).alias("volatility_missing"),
        (F.col("vwap_ts").isNull() if "vwap_ts" in columns else F.lit(True)).alias("vwap_missing"), (F.coalesce("cumulative_count", F.lit(0)) == 0).alias("history_missing"),
        (F.coalesce("momentum_count", F.lit(0)) < 2).alias("momentum_missing"), (F.coalesce("liquidity_count", F.lit(0)) == 0).alias("liquidity_missing"),
        F.greatest("price_timestamp", "cumulative_ts", "momentum_ts", "liquidity_ts").alias("max_feature_source_ts"),
    )


FLAGS = ["created_missing", "open_missing", "volume_missing", "open_interest_missing", "volatility_missing", "vwap_missing", "history_missing", "momentum_missing", "liquidity_missing"]


def feature_invariants(features: DataFrame) -> DataFrame:
    """One row of violation counts."""
    p = F.col("clipped_probability")
    return features.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("max_feature_source_ts") > F.col("forecast_ts")).alias("future_source"),
        F.count_if(p.isNull() | ~((p > 0) & (p < 1))).alias("bad_probability"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct("contract_id", "horizon"))).alias("duplicate_keys"),
        F.count_if(F.col("momentum_missing")).alias("momentum_missing"), F.count_if(F.col("liquidity_missing")).alias("liquidity_missing"),
    )
