"""Checks over finished tables, each PASS, PARTIAL or FAIL.

A row check is a condition that no row may meet; all checks of a table are one aggregate over it. A key check counts
rows that repeat a key, and a table check compares counts between tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.snapshots import HORIZONS
from tidemark.operators.taxonomy import FAMILY_CONFIDENCE, NOTES, summary
from tidemark.session import materialize

TABLES = ("snapshots", "features", "taxonomy", "predictions", "decomposition", "edge")
# What each table must never hold, by the check's name. A null condition counts as met.
ROW_CHECKS = {
    "snapshots": {
        "resolution_there": "resolution_ts IS NULL", "close_time_there": "close_time IS NULL", "outcome_binary": "observed_outcome IS NULL OR observed_outcome NOT IN (0, 1)",
        "time_order": "NOT (forecast_ts < resolution_ts)", "no_future_price": "price_timestamp > forecast_ts", "no_future_trade": "last_trade_ts > forecast_ts", "no_future_window": "coalesce(vwap_ts > forecast_ts, false)",
        "price_range": "snapshot_price IS NULL OR NOT snapshot_price BETWEEN 0 AND 1", "staleness_not_negative": "staleness_seconds < 0", "method_known": "snapshot_method NOT IN ('last_trade', 'vwap')",
        "horizon_known": "horizon NOT IN (" + ", ".join(f"'{h.name}'" for h in HORIZONS) + ")", "window_needs_trades": "snapshot_method = 'vwap' AND coalesce(vwap_trade_count, 0) = 0", "horizon_distance": "unix_micros(cast(resolution_ts AS timestamp)) - unix_micros(cast(forecast_ts AS timestamp)) <> horizon_seconds * 1000000",
    },
    "features": {
        "no_future_source": "max_feature_source_ts > forecast_ts", "probability_open": "clipped_probability IS NULL OR NOT (clipped_probability > 0 AND clipped_probability < 1)", "counts_not_negative": "least(cumulative_count, cumulative_volume, liquidity_count, liquidity_volume) < 0",
        "liquidity_within_history": "liquidity_count > cumulative_count", "momentum_flag_agrees": "(momentum IS NULL) <> momentum_missing", "volatility_flag_agrees": "(volatility IS NULL) <> volatility_missing", "month_agrees": "forecast_month <> date_format(forecast_ts, 'yyyy-MM')", "close_time_there": "close_time IS NULL",
    },
    "taxonomy": {
        "family_there": "event_family_id IS NULL", "domain_there": "domain IS NULL OR category IS NULL", "source_known": "taxonomy_source NOT IN (" + ", ".join(f"'{s}'" for s in NOTES) + ")", "family_source_known": "event_family_source NOT IN (" + ", ".join(f"'{s}'" for s in FAMILY_CONFIDENCE) + ")",
        "ambiguous_is_labelled": "taxonomy_ambiguous <> (domain = 'ambiguous')", "ambiguous_is_no_sport": "taxonomy_ambiguous AND is_sports", "confidence_known": "taxonomy_confidence NOT IN ('manual', 'high', 'medium', 'low', 'ambiguous')",
    },
    "predictions": {
        "probability_range": "predicted_probability IS NULL OR NOT predicted_probability BETWEEN 0 AND 1", "outcome_binary": "observed_outcome IS NULL OR observed_outcome NOT IN (0, 1)", "keys_there": "row_id IS NULL OR contract_id IS NULL OR fold_id IS NULL OR model_name IS NULL",
        "time_order": "NOT (forecast_ts < resolution_ts)", "raw_is_unchanged": "model_name = 'raw' AND abs(predicted_probability - raw_probability) > 1e-9", "fold_is_its_month": "fold_id <> concat('fold_', date_format(forecast_ts, 'yyyy_MM'))",
    },
    "edge": {
        "costs_not_negative": "least(fee_cost, spread_cost, slippage_cost, capital_lockup_cost, effective_cost) < 0", "cost_covers_price": "effective_cost < entry_price", "price_range": "NOT entry_price BETWEEN 0 AND 1", "no_synthetic_no_price": "trade_side = 'NO' AND entry_price_source <> 'explicit_no_ask_quote'",
        "sides_known": "trade_side NOT IN ('YES', 'NO')", "edge_adds_up": "abs(side_probability - effective_cost - net_edge) > 1e-12", "result_adds_up": "abs(side_outcome - effective_cost - realized_net) > 1e-12", "holding_not_negative": "holding_seconds < 0", "tiers_known": "friction_tier NOT IN ('fee_only', 'moderate', 'severe')",
    },
    "decomposition": {
        "identity": "abs(decomposed_brier - (reliability - resolution + uncertainty)) > 1e-12", "residual": "abs(raw_brier - decomposed_brier - residual) > 1e-12", "parts_not_negative": "least(reliability, resolution, uncertainty) < 0", "rows_there": "row_count <= 0",
    },
}
# The columns that name a row; a row's id comes before what tells the rows of one id apart.
KEYS = {"snapshots": ["contract_id", "horizon"], "features": ["contract_id", "horizon"], "taxonomy": ["contract_id"], "predictions": ["fold_id", "row_id", "model_name"], "edge": ["model_name", "row_id", "friction_tier", "trade_side"]}
ID_COLUMNS = {"snapshots": 1, "features": 1, "taxonomy": 1, "predictions": 2, "edge": 2}
ID = ["__h", "__i"]
#: Partitions of ids for each one of a usual shuffle: ids are counted in memory.
SPREAD = 4


def _counts(table: DataFrame, phase: str, sums: dict[str, Column]) -> DataFrame:
    one = table.agg(*[c.alias(n) for n, c in sums.items()])
    return one.select(F.lit(phase).alias("phase"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("n")) for n in sums])).alias("x")).select("phase", "x.*")


def _ids(table: DataFrame, keys: list[str], rest: list[str], **more: Column) -> DataFrame:
    """__h and __i, the 128 bits of two hashes in place of ``keys`` and of which of them are null; __code, a hash of ``rest`` (null if all are); and ``more``. Rows of one id are of a few bytes, and those that follow one another fewer still."""
    nulls = lambda names: [F.col(c).isNull() for c in names]
    code = F.when(F.greatest(*[F.col(c).isNotNull() for c in rest], F.lit(False)), F.xxhash64(*rest, *nulls(rest))) if rest else F.lit(0).cast("long")
    return table.select(F.xxhash64(*keys, *nulls(keys)).alias("__h"), F.xxhash64(F.lit(1), *keys, *nulls(keys)).alias("__i"), code.alias("__code"), *[c.alias(n) for n, c in more.items()])


def _met(ids: DataFrame) -> DataFrame:
    """Rows of an id in one partition. They aren't counted before: as a rule ids differ, and a table of all that a task has would only be spilled."""
    return ids.repartition(SPREAD * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__h")


def row_checks(phase: str, table: DataFrame, keys: bool = True) -> DataFrame:
    """phase, name, n, status: of each row check of a table, rows that break it, and of its key the rows that repeat one (if ``keys``). One scan; keys are counted by their hashes."""
    sums = {n: F.count_if(F.coalesce(F.expr(c), F.lit(True))) for n, c in ROW_CHECKS[phase].items()}
    out = _counts(table, phase, sums)
    if keys and phase in KEYS:
        size = ID_COLUMNS[phase]
        each = _met(_ids(table, KEYS[phase][:size], KEYS[phase][size:])).groupBy(*ID, "__code").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(_counts(each, phase, {"key_is_unique": F.coalesce(F.sum(F.col("n") - 1), F.lit(0))}))
    return out.withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))


def _prediction_ids(predictions: DataFrame) -> DataFrame:
    """The predictions' repeated keys and their agreement between models (as :func:`tidemark.operators.walkforward.identical_rows` has it) from one shuffle of ids."""
    each = _met(_ids(predictions, ["fold_id", "row_id"], ["model_name"])).groupBy(*ID, "__code").agg(F.count(F.lit(1)).alias("n"))
    rows = each.groupBy(*ID).agg(F.count("__code").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeated"))
    models = F.broadcast(predictions.agg(F.count_distinct("model_name").alias("models")))
    one = rows.crossJoin(models).agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated"), F.count_if((F.col("k") != F.col("models")) | (F.col("n") != F.col("k"))).alias("bad"), (F.count_distinct("models") - 1).alias("agree"))
    named = [F.struct(F.lit(p).alias("phase"), F.lit(n).alias("name"), F.col(c).cast("long").alias("n")) for p, n, c in (("predictions", "key_is_unique", "repeated"), ("walkforward", "identical_rows", "bad"), ("walkforward", "models_agree", "agree"))]
    return one.select(F.explode(F.array(*named)).alias("x")).select("x.*")


def _edge_ids(edge: DataFrame, predictions: DataFrame) -> DataFrame:
    """The candidates' repeated keys, and those without a prediction (a null in the id has none), from one shuffle of both tables' ids."""
    id_, rest = KEYS["edge"][:2], KEYS["edge"][2:]
    mine = _ids(edge, id_, rest, mine=F.lit(True), whole=F.col(id_[0]).isNotNull() & F.col(id_[1]).isNotNull())
    theirs = _ids(predictions, id_, [], mine=F.lit(False), whole=F.lit(True))
    each = _met(mine.unionByName(theirs)).groupBy(*ID, "__code", "mine", "whole").agg(F.count(F.lit(1)).alias("n"))
    rows = each.groupBy(*ID).agg(F.sum(F.when(F.col("mine"), F.col("n"))).alias("n"), F.sum(F.when(F.col("mine"), F.col("n") - 1)).alias("repeated"), F.bool_or(~F.col("mine")).alias("predicted"), F.bool_and("whole").alias("whole"))
    lost = F.when(~(F.col("predicted") & F.col("whole")), F.col("n"))
    return _counts(rows, "edge", {"key_is_unique": F.coalesce(F.sum("repeated"), F.lit(0)), "rows_are_predicted": F.coalesce(F.sum(lost), F.lit(0))})


def final_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """phase, name, status, detail. tables: TABLES. Stops after the checks for being there if one is missing."""
    spark = next(iter(tables.values())).sparkSession
    there = spark.createDataFrame([("existence", n, "PASS" if n in tables else "FAIL", "") for n in TABLES], "phase string, name string, status string, detail string")
    if set(TABLES) - set(tables):
        return there
    # Both panels are read by several checks.
    tables = tables | {n: materialize(tables[n], n) for n in ("snapshots", "features")}
    out = None
    for phase in TABLES:
        found = row_checks(phase, tables[phase], keys=phase not in ("predictions", "edge"))
        out = found if out is None else out.unionByName(found)
    # Between tables: features keep the snapshots' rows, candidates come from prediction rows.
    signed = tables["features"].select(F.lit(1).alias("x")).unionByName(tables["snapshots"].select(F.lit(-1).alias("x")))
    sizes = _counts(signed, "features", {"keeps_rows": F.abs(F.coalesce(F.sum("x"), F.lit(0)))})
    more = sizes.unionByName(_edge_ids(tables["edge"], tables["predictions"])).unionByName(_prediction_ids(tables["predictions"]))
    out = out.unionByName(more.withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("FAIL")))
    shares = summary(tables["taxonomy"])
    by_rule = shares.select(F.lit("taxonomy").alias("phase"), F.lit("family_rules").alias("name"), F.when(F.col("regex_family_share") <= 0.01, "PARTIAL").otherwise("PASS").alias("status"), F.format_number("regex_family_share", 4).alias("detail"))
    coverage = shares.select(F.lit("taxonomy").alias("phase"), F.lit("coverage").alias("name"), F.when(F.col("unknown_share") >= 0.5, "PARTIAL").otherwise("PASS").alias("status"), F.format_number("unknown_share", 4).alias("detail"))
    return there.unionByName(out.select("phase", "name", "status", F.col("n").cast("string").alias("detail"))).unionByName(by_rule).unionByName(coverage)
