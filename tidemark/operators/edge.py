"""Expected value after fees and frictions, by friction tier and side. NO prices are never made up from YES prices."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import elapsed_seconds, lockup_cost, reasons, taker_fee
from tidemark.operators.quantiles import with_percentiles
from tidemark.operators.scan import running_last, running_sum
from tidemark.session import materialize


@dataclass(frozen=True)
class Fee:
    """A rate from ``start`` up to (not with) ``end``, ISO dates; None is open."""

    name: str
    rate: float
    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class EdgeConfig:
    tiers: tuple[tuple[str, float, float], ...] = (("fee_only", 0.0, 0.0), ("moderate", 0.005, 0.005), ("severe", 0.01, 0.015))
    sides: tuple[str, ...] = ("YES",)
    quotes: bool = False
    schedule: tuple[Fee, ...] = (Fee("early", 0.07, None, "1998-01-01"), Fee("late", 0.05, "1998-01-01", None))
    min_net_edge: float = 0.02
    min_price: float = 0.01
    max_price: float = 0.99
    annual_rate: float = 0.05
    lockup: bool = True
    contracts: int = 1
    max_staleness: float | None = None
    min_liquidity: float | None = None
    min_volume: float | None = None
    max_quote_staleness: float | None = None
    keep: tuple[str, ...] = field(default=("domain",))


def _in(fee: Fee, at: Column) -> Column:
    ok = F.lit(True)
    if fee.start:
        ok = ok & (at >= F.lit(fee.start).cast("timestamp_ntz"))
    if fee.end:
        ok = ok & (at < F.lit(fee.end).cast("timestamp_ntz"))
    return ok


def fee_entry(schedule: tuple[Fee, ...], at: Column) -> Column:
    """(name, rate) of the last entry that holds at a time; of the last entry at all where none does."""
    validate_schedule(schedule)
    as_struct = lambda f: F.struct(F.lit(f.name).alias("name"), F.lit(f.rate).alias("rate"))
    return F.coalesce(*[F.when(_in(f, at), as_struct(f)) for f in reversed(schedule)], as_struct(schedule[-1]))


def asof_quotes(rows: DataFrame, quotes: DataFrame, ts: str = "forecast_ts") -> DataFrame:
    """Each row with its contract's latest quote up to its time, an equal time included, and the quote's age in seconds; of quotes at one time the largest (yes_ask, yes_bid).

    Rows and quotes are one union, sorted by contract and time in ranges, and the quote is the last one of a scan over them. A contract's history never meets in one task, and no pairs are made.
    """
    sides = [c for c in ("yes_bid", "yes_ask", "no_bid", "no_ask") if c in quotes.columns]
    left = rows.select("contract_id", F.col(ts).alias("__t"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row"))
    right = quotes.select("contract_id", F.col("quote_ts").alias("__t"), F.lit(0).alias("__kind"), F.struct("quote_ts", *sides).alias("__q"), F.col("yes_ask").alias("__ask"), F.col("yes_bid").alias("__bid"))
    # A number spreads rows of one time over ranges.
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__id", F.monotonically_increasing_id())
    found = running_last(both, ["contract_id"], ["__t", "__kind", "__ask", "__bid", "__id"], "__q", "__last").where("__kind = 1")
    return found.select("__row.*", "__last.*").withColumn("quote_staleness_seconds", elapsed_seconds(F.col("quote_ts"), F.col(ts)))


def base_reasons(config: EdgeConfig) -> Column:
    p, y = F.col("predicted_probability"), F.col("observed_outcome")
    pairs = [
        (p.isNull() | ~p.between(0, 1), "invalid_predicted_probability"),
        (~F.coalesce(y.isin(0, 1), F.lit(False)), "invalid_observed_outcome"),
        (F.col("holding_seconds").isNull() | (F.col("holding_seconds") < 0), "invalid_holding_period"),
    ]
    for limit, c, missing, bad, over in (
        (config.max_staleness, "staleness_seconds", "missing_staleness", "stale_price", True),
        (config.min_liquidity, "liquidity", "missing_liquidity_proxy", "low_liquidity_proxy", False),
        (config.min_volume, "cumulative_volume", "missing_cumulative_volume", "low_cumulative_volume", False),
    ):
        if limit is not None:
            x = F.col(c)
            pairs += [(x.isNull(), missing), (F.coalesce((x > limit) if over else (x < limit), F.lit(False)), bad)]
    return reasons(*pairs)


def _side_reasons(config: EdgeConfig) -> Column:
    e = F.col("entry_price")
    no = lambda c: F.coalesce(c, F.lit(False))
    pairs = [(e.isNull() | ~e.between(0, 1), "invalid_entry_price"), (no(e < config.min_price), "entry_price_below_min"), (no(e > config.max_price), "entry_price_above_max")]
    if config.quotes:
        s = F.col("quote_staleness_seconds")
        pairs += [(F.col("quote_ts").isNull(), "missing_quote"), (s.isNull() | (s < 0), "invalid_quote_staleness")]
        if config.max_quote_staleness is not None:
            pairs.append((no(s > config.max_quote_staleness), "stale_quote"))
    return reasons(*pairs)


def _prepared(predictions: DataFrame, config: EdgeConfig) -> DataFrame:
    rows = predictions.withColumn("holding_seconds", elapsed_seconds(F.col("forecast_ts"), F.col("resolution_ts")))
    return rows.withColumn("exclusion_reason", base_reasons(config))


def _sides(rows: DataFrame, config: EdgeConfig) -> DataFrame:
    """Eligible rows by tier and side, with entry price, the side's probability and outcome, and side_reason."""
    grid = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(sp).alias("spread"), F.lit(sl).alias("slippage"), F.lit(side).alias("side")) for n, sp, sl in config.tiers for side in config.sides])
    out = rows.withColumn("__t", F.explode(grid))
    yes = F.col("__t.side") == "YES"
    if config.quotes:
        price = F.when(yes, F.col("yes_ask")).otherwise(F.col("no_ask"))
        source = F.when(yes, "explicit_yes_ask_quote").otherwise("explicit_no_ask_quote")
    else:
        price, source = F.when(yes, F.col("raw_probability")), F.when(yes, "transaction_snapshot_proxy").otherwise("no_price_unavailable")
    p, y = F.col("predicted_probability"), F.col("observed_outcome")
    out = out.withColumns({
        "friction_tier": F.col("__t.name"), "trade_side": F.col("__t.side"), "entry_price": price, "entry_price_source": source, "spread_cost": F.col("__t.spread"), "slippage_cost": F.col("__t.slippage"),
        "side_probability": F.when(yes, p).otherwise(1 - p), "side_outcome": F.when(yes, y).otherwise(1 - y),
    })
    return out.withColumn("side_reason", _side_reasons(config)).drop("__t")


def simulate(predictions: DataFrame, config: EdgeConfig = EdgeConfig(), rates: tuple[float, ...] = ()) -> DataFrame:
    """Candidates (under each of ``rates`` in place of the schedule, if given): model_name, row_id, friction_tier, trade_side, costs, edges, passes_threshold (net edge at or above the limit) and simulated results. One narrow pass without a shuffle."""
    return _simulated(_eligible(predictions, config, rates), config, rates)


def simulate_counts(predictions: DataFrame, config: EdgeConfig = EdgeConfig(), rates: tuple[float, ...] = ()) -> DataFrame:
    """The candidates of :func:`simulate` with their costs, edges and results, those that agree in all as one row with ``n``. Predictions are counted and written before tiers, sides and rates repeat them; summaries scan the counts."""
    quoted = ("yes_ask", "no_ask", "quote_ts", "quote_staleness_seconds") if config.quotes else ()
    names = ["model_name", "raw_probability", "predicted_probability", "observed_outcome", "holding_seconds", *quoted, *(() if rates else ("fee_name", "fee_rate"))]
    rows = _eligible(predictions, config, rates)
    counts = rows.groupBy(*[c for c in names if c in rows.columns]).agg(F.count(F.lit(1)).alias("n"))
    return _simulated(materialize(counts.withColumns({"exclusion_reason": F.lit("")}), "candidates"), config, rates)


def _eligible(predictions: DataFrame, config: EdgeConfig, rates: tuple[float, ...]) -> DataFrame:
    """Rows without a reason against them, with their fee, which doesn't depend on tier and side, unless ``rates`` replace it."""
    rows = _prepared(predictions, config).where("exclusion_reason = ''")
    if rates:
        return rows
    return rows.withColumn("__fee", fee_entry(config.schedule, F.col("forecast_ts"))).withColumns({"fee_name": F.col("__fee.name"), "fee_rate": F.col("__fee.rate")}).drop("__fee")


def _simulated(rows: DataFrame, config: EdgeConfig, rates: tuple[float, ...]) -> DataFrame:
    rows = _sides(rows, config).where("side_reason = ''")
    if rates:  # what doesn't depend on the rate is done before
        rows = rows.withColumns({"fee_name": F.lit("scenario"), "fee_rate": F.explode(F.array(*map(F.lit, rates)))})
    rows = rows.withColumn("fee_cost", taker_fee(F.col("fee_rate"), F.col("entry_price")))
    rows = rows.withColumn("cost_before_lockup", F.col("entry_price") + F.col("fee_cost") + F.col("spread_cost") + F.col("slippage_cost"))
    lock = lockup_cost(F.col("cost_before_lockup"), config.annual_rate, F.col("holding_seconds")) if config.lockup else F.lit(0.0)
    rows = rows.withColumn("capital_lockup_cost", lock).withColumn("effective_cost", F.col("cost_before_lockup") + F.col("capital_lockup_cost")).where("effective_cost >= 0")
    rows = rows.withColumns({"gross_edge": F.col("side_probability") - F.col("entry_price"), "net_edge": F.col("side_probability") - F.col("effective_cost"), "realized_net": F.col("side_outcome") - F.col("effective_cost")})
    rows = rows.withColumns({"passes_threshold": F.col("net_edge") >= config.min_net_edge, "realized_total": F.col("realized_net") * config.contracts})
    return rows.drop("exclusion_reason", "side_reason")


def excluded(predictions: DataFrame, config: EdgeConfig = EdgeConfig()) -> DataFrame:
    """exclusion_reason (all reasons, joined by ;), n: of rows, and of rows by tier and side."""
    rows = _prepared(predictions, config)
    base = rows.where("exclusion_reason <> ''").select("exclusion_reason")
    side = _sides(rows.where("exclusion_reason = ''"), config).where("side_reason <> ''").select(F.col("side_reason").alias("exclusion_reason"))
    return base.unionByName(side).groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


def tier_summary(found: DataFrame, scenarios: dict[float, Column] | None = None, more: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Per model, tier, side and ``more``: counts, means, medians, and the same of the selected candidates. With ``weight`` a row of ``found`` stands for so many (:func:`simulate_counts`). With ``scenarios`` (a value and what it selects) a row for each, with its value as scenario; what doesn't depend on the selection is summed once."""
    key = ["model_name", "friction_tier", "trade_side", *more]
    options = scenarios or {0.0: F.col("passes_threshold")}
    n = F.col(weight) if weight else F.lit(1).cast("long")
    chosen = []
    for k, keeps in enumerate(options.values()):
        of = lambda c, keeps=keeps: F.when(keeps, F.col(c) * n)
        chosen += [F.sum(F.when(keeps, n).otherwise(0)).alias(f"selected{k}"), F.sum(of("net_edge")).alias(f"net{k}"), F.sum(of("realized_net")).alias(f"realized{k}"), F.sum(of("realized_total")).alias(f"selected_total{k}")]
    sums = with_percentiles(found, key, "net_edge", {"median_net_edge": 0.5}, F.sum(n).alias("candidates"), F.sum(F.col("net_edge") * n).alias("net"), F.sum(F.col("effective_cost") * n).alias("cost"), *chosen, weight=weight)
    n = F.col("candidates")

    def scenario(k: int, x: float) -> Column:
        m = F.nullif(F.col(f"selected{k}"), F.lit(0))
        return F.struct(
            F.lit(float(x)).alias("scenario"), F.col(f"selected{k}").alias("selected"), (F.col(f"selected{k}") / n).alias("selected_share"), (F.col(f"net{k}") / m).alias("selected_mean_net_edge"),
            (F.col(f"realized{k}") / m).alias("selected_mean_realized"), F.col(f"selected_total{k}").alias("selected_total"),
        )

    rows = sums.withColumn("__s", F.explode(F.array(*[scenario(k, x) for k, x in enumerate(options)])))
    out = rows.select(*key, "candidates", (F.col("net") / n).alias("mean_net_edge"), "median_net_edge", (F.col("cost") / n).alias("mean_cost"), "__s.*")
    return out if scenarios else out.drop("scenario")


def capacity_summary(found: DataFrame, limit: float = 3.0) -> DataFrame:
    """Selected candidates by tier: those whose cumulative volume covers the limit, and their volume."""
    chosen = F.col("passes_threshold")
    return found.groupBy("model_name", "friction_tier").agg(
        F.count_if(chosen).alias("selected"), F.count_if(chosen & (F.col("cumulative_volume") >= limit)).alias("selected_with_volume"), F.coalesce(F.sum(F.when(chosen, F.col("cumulative_volume"))), F.lit(0)).alias("selected_volume")
    )


def fee_audit(found: DataFrame, schedule: tuple[Fee, ...]) -> DataFrame:
    """Every schedule entry with its count of candidates, zero included."""
    entries = found.sparkSession.createDataFrame([(f.name, f.rate) for f in schedule], "fee_name string, fee_rate double")
    counts = found.groupBy("fee_name").agg(F.count(F.lit(1)).alias("n"))
    return entries.join(counts, "fee_name", "left").select("fee_name", "fee_rate", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative_pnl(found: DataFrame) -> DataFrame:
    """Selected candidates with their running total by model, tier and side, in the order of (forecast_ts, row_id)."""
    key = ["model_name", "friction_tier", "trade_side"]
    chosen = found.where("passes_threshold").select(*key, "forecast_ts", "row_id", "realized_total")
    return running_sum(chosen, key, ["forecast_ts", "row_id"], "realized_total", "cumulative")


class FeeError(ValueError):
    """A fee schedule that can't be applied."""


def validate_schedule(schedule: tuple[Fee, ...]) -> tuple[Fee, ...]:
    """The schedule, if it has entries, different names, rates from 0 to below 1, ISO dates, and every end after its start. Raises :class:`FeeError`."""
    if not schedule:
        raise FeeError("an empty fee schedule")
    if len({f.name for f in schedule}) < len(schedule):
        raise FeeError("fee names are repeated")
    for f in schedule:
        if not 0 <= f.rate < 1:
            raise FeeError(f"{f.name}: rate {f.rate}")
        try:
            start, end = (dt.date.fromisoformat(x) if x else None for x in (f.start, f.end))
        except ValueError as bad:
            raise FeeError(f"{f.name}: {bad}") from bad
        if start and end and end <= start:
            raise FeeError(f"{f.name} ends before it starts")
    return schedule


def executability(predictions: DataFrame, found: DataFrame, config: EdgeConfig = EdgeConfig()) -> DataFrame:
    """One row: the mode, rows and quotes that went in, candidates, those of the NO side, NO prices without a quote and quotes from the future (both 0 in a sound run), and the exclusions as JSON. Never evidence of profits: quotes have no depth."""
    late = F.col("quote_ts") > F.col("forecast_ts") if "quote_ts" in found.columns else F.lit(False)
    quoted = F.col("quote_ts").isNotNull() if config.quotes and "quote_ts" in predictions.columns else F.lit(False)
    no = F.col("trade_side") == "NO"
    sums = [
        predictions.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if(quoted).alias("rows_with_quote")),
        found.agg(F.count(F.lit(1)).alias("candidate_rows"), F.count_if(no).alias("no_side_rows"), F.count_if(no & (F.col("entry_price_source") != "explicit_no_ask_quote")).alias("synthetic_no_rows"), F.count_if(late).alias("future_quote_rows")),
        excluded(predictions, config).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("exclusion_reason", "n"))))).alias("exclusions")),
    ]
    one = sums[0].withColumn("__k", F.lit(1))
    for more in sums[1:]:  # one row each
        one = one.join(more.withColumn("__k", F.lit(1)), "__k")
    mode = "quote_snapshot_proxy" if config.quotes else "transaction_snapshot_proxy"
    return one.drop("__k").withColumns({"execution_mode": F.lit(mode), "depth_available": F.lit(False), "profit_evidence": F.lit(False)})
