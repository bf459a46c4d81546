"""Cleaning with counted exclusion reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import first_reason, reasons


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def contract_reason() -> Column:
    """The first reason against a raw market row; null for eligible ones."""
    return first_reason(
        (~_filled("ticker"), "missing_contract_id"),
        (F.coalesce(F.col("market_type"), F.lit("")) != "binary", "market_type_not_binary"),
        (F.coalesce(F.col("status"), F.lit("")) != "finalized", "status_not_finalized"),
        (~F.coalesce(_filled("result"), F.lit(False)), "missing_result"),
        (~F.col("result").isin("yes", "no"), "invalid_result"),
        (F.col("close_time").isNull(), "missing_close_time"),
    )


def clean_contracts(markets: DataFrame) -> DataFrame:
    """Eligible markets, one row per ticker: of each column the last value that is not null, by fetched_at."""
    eligible = markets.where(contract_reason().isNull())
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("fetched_at"))).alias(c) for c in markets.columns if c not in ("ticker", "fetched_at")]
    rows = eligible.groupBy(F.col("ticker").alias("contract_id")).agg(*last)
    return rows.withColumnsRenamed({"event_ticker": "event_id", "result": "outcome"})


def contract_exclusions(markets: DataFrame) -> DataFrame:
    """reason, n: exclusions by first reason, repeated snapshots of eligible tickers, and the raw and cleaned rows."""
    tagged = markets.select("ticker", contract_reason().alias("reason"))
    named = tagged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    sums = tagged.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reason").isNull()).alias("ok"), F.count_distinct(F.when(F.col("reason").isNull(), F.col("ticker"))).alias("kept"))
    more = sums.select(F.explode(F.array(
        F.struct(F.lit("raw_rows").alias("reason"), F.col("raw").alias("n")), F.struct(F.lit("cleaned_rows").alias("reason"), F.col("kept").alias("n")),
        F.struct(F.lit("duplicate_resolved_market_snapshot").alias("reason"), (F.col("ok") - F.col("kept")).alias("n")),
    )).alias("x")).select("x.reason", "x.n")
    return named.unionByName(more).where("n > 0")


def trade_reason(resolved: Column) -> Column:
    return first_reason(
        (~_filled("trade_id"), "missing_trade_id"),
        (~resolved, "contract_not_resolved_binary"),
        (F.col("created_time").isNull(), "missing_source_ts"),
        (~F.coalesce(F.col("yes_price").between(1, 99), F.lit(False)), "invalid_yes_price"),
        (~F.coalesce(F.col("no_price").between(1, 99), F.lit(False)), "invalid_no_price"),
        (F.coalesce(F.col("count"), F.lit(0)) <= 0, "invalid_volume"),
        (~F.coalesce(F.col("taker_side").isin("yes", "no"), F.lit(False)), "invalid_taker_side"),
    )


def _tagged_trades(trades: DataFrame, contracts: DataFrame) -> DataFrame:
    ids = contracts.select(F.col("contract_id").alias("ticker"), F.lit(True).alias("known")).distinct()
    return trades.join(ids, "ticker", "left").withColumn("reason", trade_reason(F.coalesce("known", F.lit(False))))


def clean_prices(trades: DataFrame, contracts: DataFrame) -> DataFrame:
    """Valid trades of resolved contracts, with prices as shares of 1."""
    good = trades.where(trade_reason(F.lit(True)).isNull()).join(contracts.select(F.col("contract_id").alias("ticker")), "ticker", "left_semi")
    return good.select("trade_id", F.col("ticker").alias("contract_id"), F.col("created_time").alias("source_ts"), F.col("yes_price").alias("yes_price_cents"), F.col("no_price").alias("no_price_cents"), (F.col("yes_price") / 100.0).alias("yes_price"), (F.col("no_price") / 100.0).alias("no_price"), F.col("count").alias("volume"), "taker_side")


def trade_exclusions(trades: DataFrame, contracts: DataFrame) -> DataFrame:
    return _tagged_trades(trades, contracts).groupBy(F.coalesce("reason", F.lit("cleaned_rows")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


QUOTE_SIDES = ("yes_bid", "yes_ask", "no_bid", "no_ask")


def _cents(c: str) -> Column:
    """A quote in cents; texts count if they are numbers, anything else is null."""
    return F.col(c).try_cast("double")


def quote_reasons() -> Column:
    ok = lambda c: _cents(c).between(0, 100)
    return reasons(
        (~_filled("ticker"), "missing_contract_id"),
        (F.col("fetched_at").try_cast("timestamp_ntz").isNull(), "missing_quote_ts"),
        *[(~ok(c), f"invalid_{c}") for c in QUOTE_SIDES],
        (_cents("yes_bid") > _cents("yes_ask"), "yes_bid_above_ask"),
        (_cents("no_bid") > _cents("no_ask"), "no_bid_above_ask"),
    )


def normalize_quotes(raw: DataFrame) -> DataFrame:
    """Valid quotes as shares of 1, with their constants; times are UTC."""
    sides = [(_cents(c) / 100.0).alias(c) for c in QUOTE_SIDES]
    return raw.where(quote_reasons() == "").select(F.col("ticker").alias("contract_id"), F.col("fetched_at").try_cast("timestamp_ntz").alias("quote_ts"), *sides, F.lit("market_snapshot").alias("quote_source"), F.lit(False).alias("depth_available"))


def quote_exclusions(raw: DataFrame) -> DataFrame:
    """reason, n: of excluded quotes, by their first reason."""
    return raw.withColumn("r", quote_reasons()).where("r <> ''").groupBy(F.split("r", ";")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))
