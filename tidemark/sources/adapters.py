"""The market relations that the queries run on, from the star-schema test tables.

Times stay without a zone (they are UTC), as the files have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contract_id, event_id, outcome, created_ts, open_ts, close_time, resolution_ts, volume, open_interest: one per user of events."""
    u = F.col("user_id")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    end = F.expr("timestamp_ntz'2024-01-16 00:00:00' + make_dt_interval(0, user_id * 5 % 360)")
    return users.select(
        F.concat(F.lit("U"), u).alias("contract_id"),
        F.concat(F.lit("G"), u % 20).alias("event_id"),
        F.when(u % 3 == 0, "yes").otherwise("no").alias("outcome"),
        F.expr("timestamp_ntz'2023-12-01 00:00:00' + make_dt_interval(user_id % 30)").alias("created_ts"),
        F.expr("timestamp_ntz'2023-12-15 00:00:00' + make_dt_interval(user_id % 10)").alias("open_ts"),
        end.alias("close_time"),
        end.alias("resolution_ts"),
        (u * 3 % 100).alias("volume"),
        (u % 50).alias("open_interest"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, contract_id, source_ts, cents, price, volume, taker_side: one per event."""
    cents = 1 + F.floor("value") % 99
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trade_id"),
        F.concat(F.lit("U"), F.col("user_id")).alias("contract_id"),
        F.col("ts").alias("source_ts"),
        cents.alias("cents"),
        (cents / 100.0).alias("price"),
        (1 + F.col("event_id") % 50).alias("volume"),
        F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no").alias("taker_side"),
    )


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, yes_bid, yes_ask, no_bid, no_ask, fetched_at: with some crossed and out-of-range ones."""
    v = F.floor("value")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
        (v % 99).alias("yes_bid"),
        (v % 99 + F.col("event_id") % 7 - 1).alias("yes_ask"),
        (98 - v % 99).alias("no_bid"),
        (100 - v % 99 + F.col("event_id") % 5 - 1).alias("no_ask"),
        F.col("ts").alias("fetched_at"),
    )


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, ticker, count, yes_price, no_price, taker_side, created_time: from lineitem, with faults of each kind."""
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("ticker"),
        (F.col("l_linenumber").cast("long") - 1).alias("count"),
        (q * 2 + F.when(F.col("l_partkey") % 11 == 0, 10).otherwise(-1)).alias("yes_price"),
        (101 - q * 2).alias("no_price"),
        F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").alias("taker_side"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_shipdate")).alias("created_time"),
    )


def raw_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, event_ticker, market_type, title, status, result, close_time, last_price, fetched_at: from lineitem, many snapshots for a ticker."""
    k = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), k).alias("ticker"),
        F.concat(F.lit("E"), k % 50).alias("event_ticker"),
        F.when(k % 17 == 0, "scalar").otherwise("binary").alias("market_type"),
        F.when(F.col("l_linenumber") > 2, F.concat(F.lit("title "), F.col("l_linenumber"))).alias("title"),
        F.when(F.col("l_tax") > 0.05, "active").otherwise("finalized").alias("status"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "void").when(k % 2 == 0, "yes").otherwise("no").alias("result"),
        F.when(k % 13 != 0, F.col("l_shipdate")).alias("close_time"),
        F.when(F.col("l_discount") > 0.03, F.col("l_quantity").cast("long")).alias("last_price"),
        F.concat_ws("-", F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", F.lpad(F.col("l_suppkey").cast("string"), 12, "0")).alias("fetched_at"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored panel, one row per lineitem, with a natural row_id."""
    q, k = F.col("l_quantity").cast("long"), F.col("l_partkey")
    luck = (F.col("l_orderkey") * 7 + k * 13 + F.col("l_suppkey") * 5 + F.col("l_linenumber")) % 100
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.concat(F.lit("C"), F.col("l_orderkey")).alias("contract_id"),
        F.concat(F.lit("F"), F.col("l_suppkey")).alias("event_family_id"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("A", "1d", "N", "7d", "R", "6h")]), F.col("l_returnflag")).alias("horizon_name"),
        F.when(k % 4 == 0, "sports").when(k % 4 == 1, "finance").when(k % 4 == 2, "weather").alias("domain"),
        F.concat(F.lit("cat"), k % 3).alias("category"),
        F.col("l_shipdate").alias("forecast_ts"),
        F.expr("l_shipdate + make_dt_interval(l_partkey % 45 + 1)").alias("resolution_ts"),
        ((q * 2 - 1) / 100.0).alias("raw_probability"),
        F.when(luck < F.lit(10) + (q * 2 - 1) * 4 / 5, 1).otherwise(0).alias("observed_outcome"),
        F.col("l_linenumber").cast("long").alias("cumulative_volume"),
        F.when(k % 19 != 0, (k * 37 % 4000).cast("double")).alias("staleness_seconds"),
        F.when(k % 23 != 0, F.col("l_extendedprice")).alias("liquidity"),
        F.when(F.col("l_linenumber") % 3 == 0, "vwap").otherwise("last_trade").alias("snapshot_method"),
        F.when(k % 6 == 0, "low").when(k % 6 < 3, "medium").otherwise("high").alias("taxonomy_confidence"),
        (k % 29 == 0).alias("taxonomy_ambiguous"),
        (k % 4 == 0).alias("is_sports"),
    )


def models() -> dict[str, Column]:
    """Three models with fixed rules: each one's probability for a row of the panel."""
    p = F.col("raw_probability")
    return {"raw": p, "shrunk": p * 0.8 + 0.1, "sharp": F.least(F.greatest(p * 1.2 - 0.1, F.lit(0.01)), F.lit(0.99))}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's rows under the three models, with the month as the fold."""
    each = F.array(*[F.struct(F.lit(name).alias("name"), p.alias("p")) for name, p in models().items()])
    rows = panel(spark, sf_dir).withColumn("m", F.explode(each))
    return rows.withColumns({"model_name": F.col("m.name"), "predicted_probability": F.col("m.p"), "fold_id": F.date_format("forecast_ts", "'fold_'yyyy_MM")}).drop("m")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contract_id, event_id, title for the taxonomy, from part."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("K"), k).alias("contract_id"),
        F.when(k % 8 != 0, F.concat_ws("-", F.regexp_replace(F.upper("p_brand"), "#", ""), F.concat(F.substring("p_type", 1, 3), k % 40))).alias("event_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("subtitle"),
    )
