"""All queries of the library by name, and the SQL of those that SQL can express.

Doubles are rounded to nine digits on both sides, since sums depend on the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import audit, calibration, cleaning, edge, features, folds, inference, metrics, raw_audit, reports, robustness, snapshots, taxonomy, walkforward
from tidemark.plans import sql
from tidemark.session import materialize
from tidemark.sources import adapters, readers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        _QUERIES[f.__name__] = run
        if text:
            _SQL[f.__name__] = text
        return f

    return add


def round9(x: Column) -> Column:
    """A double rounded to nine digits as SQL does it: times 1e9, to the nearest whole number with halves away from zero, over 1e9. Spark's own round goes through the decimal text of each value."""
    v = x * F.lit(1e9)
    size = F.abs(v)
    whole = F.floor(size)
    up = (size - whole.cast("double") >= 0.5).cast("long")
    near = F.when(size < F.lit(2.0**52), F.signum(v) * (whole + up).cast("double")).otherwise(v) / F.lit(1e9)
    return F.when(size == F.lit(float("inf")), x).otherwise(near)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(round9(df[f"`{c}`"]) + F.lit(0.0)).alias(c) if t == "double" else df[f"`{c}`"] for c, t in df.dtypes])


def r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 9) + 0.0"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Brier score by horizon of the snapshot panel."""
    return _QUERIES["d1_snapshot_brier_by_horizon"](spark, sf_dir)


# ---- Snapshots and features


#: The default policies, with the window average preferred at two horizons so that both methods occur.
HORIZONS = tuple(replace(h, prefer_vwap=h.name in ("1d", "6h")) for h in snapshots.HORIZONS)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_panel(adapters.contracts(spark, d), adapters.prices(spark, d), HORIZONS)


@query(f"WITH {sql.SNAPSHOT_PANEL} SELECT * REPLACE ({r('snapshot_price')} AS snapshot_price, {r('last_trade_price')} AS last_trade_price, {r('vwap_price')} AS vwap_price) FROM snapshots")
def d1_snapshot_panel(spark, d):
    return _snapshots(spark, d)


@query(f"WITH {sql.SNAPSHOT_PANEL} SELECT horizon, count(*) AS row_count, {r('avg(power(snapshot_price - observed_outcome, 2))')} AS mean_brier FROM snapshots GROUP BY horizon")
def d1_snapshot_brier_by_horizon(spark, d):
    p = F.pow(F.col("snapshot_price") - F.col("observed_outcome"), F.lit(2))
    return _snapshots(spark, d).groupBy("horizon").agg(F.count(F.lit(1)).alias("row_count"), F.avg(p).alias("mean_brier"))


@query(f"WITH {sql.MARKET} SELECT contract_id, horizon, forecast_ts, max_staleness::BIGINT AS max_staleness FROM candidates")
def j1_candidates(spark, d):
    return snapshots.candidates(adapters.contracts(spark, d), HORIZONS).select("contract_id", "horizon", "forecast_ts", "max_staleness")


@query(f"""WITH {sql.SNAPSHOT_PANEL} SELECT c.contract_id, c.horizon, l.source_ts AS last_ts, {r('l.price')} AS last_price, v.vwap_trade_count, v.vwap_volume
FROM candidates c LEFT JOIN latest l USING (contract_id, horizon) LEFT JOIN vwap v USING (contract_id, horizon)""")
def j2_asof_and_window(spark, d):
    found = snapshots.snapshot_stats(snapshots.candidates(adapters.contracts(spark, d), HORIZONS), adapters.prices(spark, d))
    return found.select("contract_id", "horizon", F.col("last.source_ts").alias("last_ts"), F.col("last.price").alias("last_price"), "vwap_trade_count", "vwap_volume")


@query(f"""WITH {sql.SNAPSHOT_PANEL} SELECT c.horizon, count(*) AS candidates, count(*) FILTER (l.source_ts IS NULL) AS no_price, count(*) FILTER (l.source_ts < c.forecast_ts - to_seconds(c.max_staleness)) AS stale,
count(*) FILTER (l.source_ts >= c.forecast_ts - to_seconds(c.max_staleness)) AS kept FROM candidates c LEFT JOIN latest l USING (contract_id, horizon) GROUP BY c.horizon""")
def a23_snapshot_drop_counts(spark, d):
    return snapshots.drop_counts(adapters.contracts(spark, d), adapters.prices(spark, d), HORIZONS)


@query(f"""WITH {sql.SNAPSHOT_PANEL} SELECT count(*) AS row_count, count(*) FILTER (NOT forecast_ts < resolution_ts) AS bad_order, count(*) FILTER (price_timestamp > forecast_ts) AS future_price,
count(*) FILTER (last_trade_ts > forecast_ts) AS future_last_trade, count(*) FILTER (vwap_ts > forecast_ts) AS future_vwap, count(*) - count(DISTINCT (contract_id, horizon)) AS duplicate_keys,
count(*) FILTER (snapshot_price IS NULL OR NOT snapshot_price BETWEEN 0 AND 1) AS bad_price FROM snapshots""")
def d2_snapshot_invariants(spark, d):
    return snapshots.invariants(_snapshots(spark, d))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.snapshots_with_features(adapters.contracts(spark, d), adapters.prices(spark, d), HORIZONS)


_FEATURE_SQL = f"""WITH {sql.SNAPSHOT_PANEL}, joined AS (
  SELECT s.contract_id, s.horizon, s.forecast_ts, p.* EXCLUDE (contract_id) FROM snapshots s JOIN prices p ON p.contract_id = s.contract_id AND p.source_ts <= s.forecast_ts
), cumulative AS (SELECT contract_id, horizon, count(*) AS n, sum(volume) AS v, max(source_ts) AS t FROM joined GROUP BY ALL
), day AS (SELECT contract_id, horizon, count(*) AS n, first(price ORDER BY source_ts, trade_id) AS p0, first(price ORDER BY source_ts DESC, trade_id DESC) AS p1, stddev_samp(price) AS sd, max(source_ts) AS t
  FROM joined WHERE source_ts >= forecast_ts - INTERVAL 1 DAY GROUP BY ALL
), week AS (SELECT contract_id, horizon, count(*) AS n, sum(volume) AS v, max(source_ts) AS t FROM joined WHERE source_ts >= forecast_ts - INTERVAL 7 DAY GROUP BY ALL
), features AS (
  SELECT s.*, c.created_ts, c.open_ts, c.volume AS contract_volume, c.open_interest, least(greatest(snapshot_price, 0.001), 0.999) AS cp, CAST(coalesce(cu.n, 0) AS BIGINT) AS cumulative_count, CAST(coalesce(cu.v, 0) AS BIGINT) AS cumulative_volume,
    CAST(coalesce(w.n, 0) AS BIGINT) AS liquidity_count, CAST(coalesce(w.v, 0) AS BIGINT) AS liquidity_volume, CASE WHEN day.n >= 2 THEN p1 - p0 END AS momentum, CASE WHEN day.n >= 2 THEN sd END AS volatility,
    coalesce(day.n, 0) < 2 AS momentum_missing, coalesce(w.n, 0) = 0 AS liquidity_missing, greatest(s.price_timestamp, cu.t, day.t, w.t) AS max_feature_source_ts
  FROM snapshots s LEFT JOIN cumulative cu USING (contract_id, horizon) LEFT JOIN day USING (contract_id, horizon) LEFT JOIN week w USING (contract_id, horizon) LEFT JOIN contracts c USING (contract_id))"""
_FEATURES = ["cumulative_count", "cumulative_volume", "liquidity_count", "liquidity_volume", "public_liquidity_proxy", "momentum", "volatility", "forecast_month", "listing_month", "contract_volume", "open_interest", "momentum_missing", "liquidity_missing", "max_feature_source_ts"]


@query(_FEATURE_SQL + f""" SELECT contract_id, horizon, {r('cp')} AS clipped_probability, {r('ln(cp / (1 - cp))')} AS logit_probability, cumulative_count, cumulative_volume, liquidity_count, liquidity_volume,
{r('ln(1 + liquidity_volume)')} AS public_liquidity_proxy, {r('momentum')} AS momentum, {r('volatility')} AS volatility, strftime(forecast_ts, '%Y-%m') AS forecast_month, strftime(open_ts, '%Y-%m') AS listing_month,
contract_volume, open_interest, momentum_missing, liquidity_missing, max_feature_source_ts FROM features""")
def d6_feature_panel(spark, d):
    return _features(spark, d).select("contract_id", "horizon", "clipped_probability", "logit_probability", *_FEATURES)


@query(_FEATURE_SQL + """ SELECT contract_id, horizon, cumulative_count, cumulative_volume, liquidity_count, momentum_missing FROM features""")
def j12_features_of_a_given_panel(spark, d):
    """The join from a panel to the prices, where the panel is given."""
    found = features.feature_panel(_snapshots(spark, d), adapters.prices(spark, d), adapters.contracts(spark, d))
    return found.select("contract_id", "horizon", "cumulative_count", "cumulative_volume", "liquidity_count", "momentum_missing")


@query(_FEATURE_SQL + """ SELECT count(*) AS row_count, count(*) FILTER (max_feature_source_ts > forecast_ts) AS future_source, count(*) FILTER (NOT (cp > 0 AND cp < 1)) AS bad_probability,
count(*) - count(DISTINCT (contract_id, horizon)) AS duplicate_keys, count(*) FILTER (momentum_missing) AS momentum_missing, count(*) FILTER (liquidity_missing) AS liquidity_missing FROM features""")
def d7_feature_invariants(spark, d):
    return features.feature_invariants(_features(spark, d))


# ---- Cleaning

_RAW_MARKETS = """markets AS (
  SELECT 'P' || l_partkey AS ticker, 'E' || (l_partkey % 50) AS event_ticker, CASE WHEN l_partkey % 17 = 0 THEN 'scalar' ELSE 'binary' END AS market_type, CASE WHEN l_linenumber > 2 THEN 'title ' || l_linenumber END AS title,
    CASE WHEN l_tax > 0.05 THEN 'active' ELSE 'finalized' END AS status, CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN 'void' WHEN l_partkey % 2 = 0 THEN 'yes' ELSE 'no' END AS result,
    CASE WHEN l_partkey % 13 <> 0 THEN l_shipdate END AS close_time, CASE WHEN l_discount > 0.03 THEN CAST(l_quantity AS BIGINT) END AS last_price,
    strftime(l_shipdate, '%Y%m%d') || '-' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS fetched_at FROM lineitem
), tagged AS (
  SELECT *, CASE WHEN market_type <> 'binary' THEN 'market_type_not_binary' WHEN status <> 'finalized' THEN 'status_not_finalized' WHEN result = '' THEN 'missing_result' WHEN result NOT IN ('yes', 'no') THEN 'invalid_result' WHEN close_time IS NULL THEN 'missing_close_time' END AS reason FROM markets
), cleaned AS (
  SELECT ticker AS contract_id, arg_max(event_ticker, fetched_at) AS event_id, arg_max(title, fetched_at) FILTER (title IS NOT NULL) AS title, arg_max(result, fetched_at) AS outcome, arg_max(close_time, fetched_at) AS close_time, arg_max(last_price, fetched_at) FILTER (last_price IS NOT NULL) AS last_price
  FROM tagged WHERE reason IS NULL GROUP BY ticker)"""
_RAW_TRADES = """trades AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_id, 'P' || l_partkey AS ticker, CAST(l_linenumber AS BIGINT) - 1 AS volume, CAST(l_quantity AS BIGINT) * 2 + CASE WHEN l_partkey % 11 = 0 THEN 10 ELSE -1 END AS yes_price,
    101 - CAST(l_quantity AS BIGINT) * 2 AS no_price, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' END AS taker_side, CASE WHEN l_suppkey % 10 <> 0 THEN l_shipdate END AS created_time FROM lineitem
), trade_tagged AS (
  SELECT *, CASE WHEN ticker NOT IN (SELECT contract_id FROM cleaned) THEN 'contract_not_resolved_binary' WHEN created_time IS NULL THEN 'missing_source_ts' WHEN NOT yes_price BETWEEN 1 AND 99 THEN 'invalid_yes_price'
    WHEN NOT no_price BETWEEN 1 AND 99 THEN 'invalid_no_price' WHEN volume <= 0 THEN 'invalid_volume' WHEN taker_side IS NULL THEN 'invalid_taker_side' END AS reason FROM trades)"""


@query(f"WITH {_RAW_MARKETS} SELECT * FROM cleaned")
def c1_clean_contracts(spark, d):
    return cleaning.clean_contracts(adapters.raw_markets(spark, d)).select("contract_id", "event_id", "title", "outcome", "close_time", "last_price")


@query(f"""WITH {_RAW_MARKETS} SELECT reason, count(*) AS n FROM tagged WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'raw_rows', count(*) FROM tagged UNION ALL SELECT 'cleaned_rows', count(*) FROM cleaned
UNION ALL SELECT 'duplicate_resolved_market_snapshot', count(*) FILTER (reason IS NULL) - count(DISTINCT ticker) FILTER (reason IS NULL) FROM tagged""")
def c4_contract_exclusions(spark, d):
    return cleaning.contract_exclusions(adapters.raw_markets(spark, d))


@query(f"WITH {_RAW_MARKETS}, {_RAW_TRADES} SELECT trade_id, ticker AS contract_id, created_time AS source_ts, yes_price AS yes_price_cents, no_price AS no_price_cents, {r('yes_price / 100.0')} AS yes_price, {r('no_price / 100.0')} AS no_price, volume, taker_side FROM trade_tagged WHERE reason IS NULL")
def c2_clean_prices(spark, d):
    return cleaning.clean_prices(adapters.raw_trades(spark, d), cleaning.clean_contracts(adapters.raw_markets(spark, d)))


@query(f"WITH {_RAW_MARKETS}, {_RAW_TRADES} SELECT coalesce(reason, 'cleaned_rows') AS reason, count(*) AS n FROM trade_tagged GROUP BY 1")
def c6_trade_exclusions(spark, d):
    return cleaning.trade_exclusions(adapters.raw_trades(spark, d), cleaning.clean_contracts(adapters.raw_markets(spark, d)))


_QUOTES = """raw_quotes AS (
  SELECT 'U' || user_id AS ticker, CAST(floor(value) AS BIGINT) % 99 AS yes_bid, CAST(floor(value) AS BIGINT) % 99 + event_id % 7 - 1 AS yes_ask, 98 - CAST(floor(value) AS BIGINT) % 99 AS no_bid, 100 - CAST(floor(value) AS BIGINT) % 99 + event_id % 5 - 1 AS no_ask, ts FROM events
), quote_tagged AS (
  SELECT *, concat_ws(';', CASE WHEN NOT yes_bid BETWEEN 0 AND 100 THEN 'invalid_yes_bid' END, CASE WHEN NOT yes_ask BETWEEN 0 AND 100 THEN 'invalid_yes_ask' END, CASE WHEN NOT no_bid BETWEEN 0 AND 100 THEN 'invalid_no_bid' END, CASE WHEN NOT no_ask BETWEEN 0 AND 100 THEN 'invalid_no_ask' END,
    CASE WHEN yes_bid > yes_ask THEN 'yes_bid_above_ask' END, CASE WHEN no_bid > no_ask THEN 'no_bid_above_ask' END) AS reason FROM raw_quotes
), quotes AS (SELECT ticker AS contract_id, ts AS quote_ts, yes_bid / 100.0 AS yes_bid, yes_ask / 100.0 AS yes_ask, no_bid / 100.0 AS no_bid, no_ask / 100.0 AS no_ask FROM quote_tagged WHERE reason = '')"""


@query(f"WITH {_QUOTES} SELECT contract_id, quote_ts, {r('yes_bid')} AS yes_bid, {r('yes_ask')} AS yes_ask, {r('no_bid')} AS no_bid, {r('no_ask')} AS no_ask, 'market_snapshot' AS quote_source, false AS depth_available FROM quotes")
def c9_normalize_quotes(spark, d):
    return cleaning.normalize_quotes(adapters.raw_quotes(spark, d))


@query(f"WITH {_QUOTES} SELECT split_part(reason, ';', 1) AS reason, count(*) AS n FROM quote_tagged WHERE reason <> '' GROUP BY 1")
def c11_quote_exclusions(spark, d):
    return cleaning.quote_exclusions(adapters.raw_quotes(spark, d))


# ---- Taxonomy

RULES = taxonomy.Taxonomy(
    exact={"BRAND7-ECO1": ("manual", "special"), "BRAND3-SMA2": ("manual", "other")},
    prefixes=(
        taxonomy.Rule("finance_a", "finance", "equity_index", 10, pattern="^BRAND1-", confidence="high"),
        taxonomy.Rule("finance_b", "finance", "crypto", 20, pattern="^(brand)?1[0-5]?-|^BRAND1[0-4]-"),
        taxonomy.Rule("sports_a", "sports", "nfl", 100, pattern="^BRAND2[0-9]?-", confidence="high", is_sports=True),
        taxonomy.Rule("by_contract", "weather", "rain", 110, pattern="^K1[0-9]$"),
    ),
    titles=(taxonomy.Rule("title_red", "color", "red", 10, keywords=("red", "ruby")), taxonomy.Rule("title_ring", "goods", "ring", 20, keywords=("ring", "small bolt")), taxonomy.Rule("title_blue", "color", "blue", 30, keywords=("BLUE",))),
    families=(taxonomy.FamilyRule("eco", 10, "-ECO([0-9]+)$", "eco:"), taxonomy.FamilyRule("lower", 20, "-sma([0-9]+)$", "sma:")),
    exact_families={"BRAND5-PRO5": "family:five"},
)
_TAXONOMY_SQL = r"""WITH t AS (
  SELECT 'K' || p_partkey AS contract_id, CASE WHEN p_partkey % 8 <> 0 THEN replace(upper(p_brand), '#', '') || '-' || substr(p_type, 1, 3) || (p_partkey % 40) END AS event_id, p_name AS title FROM part
), m AS (
  SELECT *, concat_ws(' ', coalesce(event_id, ''), contract_id) AS txt, regexp_matches(title, 'red|ruby', 'i') AS red, regexp_matches(title, 'ring|small\ bolt', 'i') AS ring, regexp_matches(title, 'BLUE', 'i') AS blue FROM t
), x AS (
  SELECT *, red::INT + ring::INT + blue::INT > 1 AS torn, coalesce(event_id IN ('BRAND7-ECO1', 'BRAND3-SMA2'), false) AS exact,
    CASE WHEN regexp_matches(txt, '^BRAND1-', 'i') THEN 'finance_a' WHEN regexp_matches(txt, '^(brand)?1[0-5]?-|^BRAND1[0-4]-', 'i') THEN 'finance_b' WHEN regexp_matches(txt, '^BRAND2[0-9]?-', 'i') THEN 'sports_a' WHEN regexp_matches(txt, '^K1[0-9]$', 'i') THEN 'by_contract' END AS prefix,
    CASE WHEN red THEN 'title_red' WHEN ring THEN 'title_ring' WHEN blue THEN 'title_blue' END AS by_title FROM m
), y AS (
  SELECT *, CASE WHEN exact THEN 'exact:' || event_id ELSE coalesce(prefix, by_title) END AS rule FROM x
), classified AS (
  SELECT contract_id, event_id, title,
    CASE WHEN torn THEN 'ambiguous' WHEN exact THEN 'manual' WHEN rule IN ('finance_a', 'finance_b') THEN 'finance' WHEN rule = 'sports_a' THEN 'sports' WHEN rule = 'by_contract' THEN 'weather' WHEN rule IN ('title_red', 'title_blue') THEN 'color' WHEN rule = 'title_ring' THEN 'goods' ELSE 'unknown' END AS domain,
    CASE WHEN torn THEN 'ambiguous' WHEN rule = 'exact:BRAND7-ECO1' THEN 'special' WHEN exact THEN 'other' WHEN rule = 'finance_a' THEN 'equity_index' WHEN rule = 'finance_b' THEN 'crypto' WHEN rule = 'sports_a' THEN 'nfl' WHEN rule = 'by_contract' THEN 'rain' WHEN rule = 'title_red' THEN 'red' WHEN rule = 'title_blue' THEN 'blue' WHEN rule = 'title_ring' THEN 'ring' ELSE 'unknown' END AS category,
    CASE WHEN exact THEN 'manual' WHEN prefix IS NOT NULL THEN 'prefix' WHEN by_title IS NOT NULL THEN 'title' ELSE 'event_id_proxy' END AS taxonomy_source,
    CASE WHEN torn THEN 'ambiguous' WHEN exact THEN 'manual' WHEN rule IN ('finance_a', 'sports_a') THEN 'high' WHEN rule IS NOT NULL THEN 'medium' ELSE 'low' END AS taxonomy_confidence, rule AS taxonomy_rule_id, torn AS taxonomy_ambiguous, NOT torn AND NOT exact AND coalesce(rule = 'sports_a', false) AS is_sports,
    CASE WHEN event_id = 'BRAND5-PRO5' THEN 'family:five' WHEN regexp_matches(event_id, '-ECO([0-9]+)$', 'i') THEN 'eco:' || regexp_extract(event_id, '-ECO([0-9]+)$', 1) WHEN regexp_matches(event_id, '-sma([0-9]+)$', 'i') THEN 'sma:' || regexp_extract(event_id, '-sma([0-9]+)$', 1) ELSE coalesce(event_id, contract_id) END AS event_family_id,
    CASE WHEN event_id = 'BRAND5-PRO5' THEN 'exact' WHEN regexp_matches(event_id, '-(ECO|SMA)[0-9]+$', 'i') THEN 'regex' WHEN event_id IS NOT NULL THEN 'event_id' ELSE 'contract_id' END AS event_family_source FROM y) """


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.classify(adapters.titles(spark, d), RULES)


@query(_TAXONOMY_SQL + "SELECT * FROM classified")
def d3_taxonomy(spark, d):
    return _classified(spark, d).drop("subtitle")


@query(_TAXONOMY_SQL + "SELECT domain, category, taxonomy_source, taxonomy_confidence, taxonomy_ambiguous, is_sports, event_family_source, count(*) AS row_count, count(DISTINCT contract_id) AS contracts, count(DISTINCT event_id) AS events, count(DISTINCT event_family_id) AS families FROM classified GROUP BY ALL")
def a20_taxonomy_audit(spark, d):
    return taxonomy.audit(_classified(spark, d))


@query(_TAXONOMY_SQL + "SELECT * FROM (SELECT domain, category, taxonomy_source, contract_id, title, CAST(row_number() OVER (PARTITION BY domain, category, taxonomy_source ORDER BY contract_id) AS INTEGER) AS rank FROM classified) WHERE rank <= 25")
def w4_taxonomy_examples(spark, d):
    return taxonomy.examples(_classified(spark, d))


@query(_TAXONOMY_SQL + f"""SELECT count(*) AS row_count, {r("avg((domain = 'unknown')::INT)")} AS unknown_share, {r('avg(taxonomy_ambiguous::INT)')} AS ambiguous_share, {r('avg(is_sports::INT)')} AS sports_share,
{r("avg((event_family_source = 'regex')::INT)")} AS regex_family_share, count(*) FILTER (event_family_id IS NULL) AS missing_family FROM classified""")
def d5_taxonomy_summary(spark, d):
    return taxonomy.summary(_classified(spark, d))


# ---- Metrics


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_groupings(metrics.scored(adapters.panel(spark, d)))


@query(f"WITH {sql.GROUPED} SELECT grouping_name, group_key, count(*) AS row_count, count(DISTINCT contract_id) AS contracts, count(DISTINCT event_family_id) AS families, {r('avg(brier)')} AS mean_brier, {r('avg(log_loss)')} AS mean_log_loss FROM grouped GROUP BY ALL")
def a5_equal_contract_metrics(spark, d):
    return metrics.equal_contract(metrics.scored(adapters.panel(spark, d)), metrics.GROUPINGS)


@query(f"""WITH {sql.GROUPED}, f AS (SELECT grouping_name, group_key, event_family_id, count(*) AS n, avg(brier) AS b, avg(log_loss) AS l FROM grouped GROUP BY ALL)
SELECT grouping_name, group_key, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS families, {r('avg(b)')} AS mean_brier, {r('avg(l)')} AS mean_log_loss FROM f GROUP BY ALL""")
def a6_equal_family_metrics(spark, d):
    return metrics.equal_family(_grouped(spark, d))


@query(f"WITH {sql.GROUPED} SELECT grouping_name, group_key, count(*) AS row_count, CAST(sum(cumulative_volume) AS BIGINT) AS total_weight, {r('sum(cumulative_volume * brier) / sum(cumulative_volume)')} AS mean_brier, {r('sum(cumulative_volume * log_loss) / sum(cumulative_volume)')} AS mean_log_loss FROM grouped WHERE cumulative_volume > 0 GROUP BY ALL")
def a7_trade_weighted_metrics(spark, d):
    return metrics.trade_weighted(_grouped(spark, d))


@query(f"""WITH {sql.GROUPED}, g AS (SELECT DISTINCT grouping_name, group_key FROM grouped), e AS (SELECT *, CAST(unnest(range(10)) AS INTEGER) AS bin FROM g),
c AS (SELECT grouping_name, group_key, bin, count(*) AS n, avg(raw_probability) AS mp, avg(observed_outcome) AS my FROM grouped GROUP BY ALL)
SELECT e.grouping_name, e.group_key, e.bin, coalesce(n, 0) AS n, {r('mp')} AS mean_p, {r('my')} AS mean_y, {r('e.bin / 10.0')} AS lower, {r('(e.bin + 1) / 10.0')} AS upper, {r('abs(mp - my)')} AS gap,
CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n < 5 THEN 'sparse' ELSE 'ok' END AS status FROM e LEFT JOIN c USING (grouping_name, group_key, bin)""")
def a9_reliability_bins(spark, d):
    return metrics.reliability(_grouped(spark, d))


_ECE_SQL = "c AS (SELECT grouping_name, group_key, bin, count(*) AS n, abs(avg(raw_probability) - avg(observed_outcome)) AS gap FROM grouped GROUP BY ALL), ece AS (SELECT grouping_name, group_key, sum(n * gap) / sum(n) AS ece FROM c GROUP BY ALL)"


@query(f"WITH {sql.GROUPED}, {_ECE_SQL} SELECT grouping_name, group_key, {r('ece')} AS ece FROM ece")
def a10_expected_calibration_error(spark, d):
    return metrics.ece(_grouped(spark, d))


@query(f"""WITH {sql.GROUPED}, {_ECE_SQL}, k AS (SELECT grouping_name, group_key, count(*) AS row_count, count(DISTINCT contract_id) AS contracts, count(DISTINCT event_family_id) AS families, avg(brier) AS b, avg(log_loss) AS l FROM grouped GROUP BY ALL)
SELECT grouping_name, group_key, row_count, contracts, families, {r('b')} AS mean_brier, {r('l')} AS mean_log_loss, {r('ece')} AS ece FROM k LEFT JOIN ece USING (grouping_name, group_key)""")
def d8_raw_evaluation(spark, d):
    return metrics.metric_table(metrics.scored(adapters.panel(spark, d)), groupings=metrics.GROUPINGS)


_WEIGHTED_SQL = f"""WITH {sql.PREDICTIONS}, w AS (
  SELECT *, 'equal_contract' AS weighting, 1.0::DOUBLE AS w FROM predictions UNION ALL SELECT *, 'equal_event_family', 1.0::DOUBLE / count(*) OVER (PARTITION BY model_name, horizon_name, event_family_id) FROM predictions
  UNION ALL SELECT *, 'trade_weighted', greatest(cumulative_volume::DOUBLE, 0) FROM predictions
), s AS (SELECT weighting, model_name, horizon_name, count(*) AS row_count, sum(w) AS tw, sum(w * brier) / sum(w) AS b, sum(w * log_loss) / sum(w) AS l FROM w GROUP BY ALL
), c AS (SELECT weighting, model_name, horizon_name, least(CAST(floor(predicted_probability * 10) AS INTEGER), 9) AS bin, count(*) AS n, sum(w) AS w, abs(sum(w * predicted_probability) - sum(w * observed_outcome)) AS gap FROM w GROUP BY ALL
), e AS (SELECT weighting, model_name, horizon_name, sum(gap) / sum(w) AS ece, count(*) FILTER (n < 5) + 10 - count(*) AS sparse FROM c GROUP BY ALL)
SELECT weighting, model_name, horizon_name, row_count, {r('tw')} AS total_weight, {r('b')} AS mean_brier, {r('l')} AS mean_log_loss, {r('ece')} AS ece, sparse AS sparse_bins, 'ok' AS status FROM s JOIN e USING (weighting, model_name, horizon_name)"""


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.scored(adapters.predictions(spark, d), "predicted_probability")


@query(_WEIGHTED_SQL)
def d28_weighting_sensitivity(spark, d):
    return robustness.weighting_sensitivity(_predictions(spark, d), ["model_name", "horizon_name"])


@query(f"""WITH {sql.PREDICTIONS}, c AS (SELECT model_name, horizon_name, least(CAST(floor(predicted_probability * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(predicted_probability) AS mp, avg(observed_outcome) AS my, sum(observed_outcome) AS sy, sum(brier) AS b FROM predictions GROUP BY ALL
), s AS (SELECT model_name, horizon_name, sum(n) AS n, sum(sy) / sum(n) AS base, sum(b) / sum(n) AS rb, sum(n * power(mp - my, 2)) / sum(n) AS rel, sum(n * my * my) / sum(n) AS second FROM c GROUP BY ALL)
SELECT model_name, horizon_name, CAST(n AS BIGINT) AS row_count, {r('base')} AS base_rate, {r('rb')} AS raw_brier, {r('rel')} AS reliability, {r('second - base * base')} AS resolution, {r('base * (1 - base)')} AS uncertainty,
{r('rel - (second - base * base) + base * (1 - base)')} AS decomposed_brier, {r('rb - (rel - (second - base * base) + base * (1 - base))')} AS residual FROM s""")
def a15_murphy_decomposition(spark, d):
    return metrics.murphy(_predictions(spark, d), keys=["model_name", "horizon_name"]).drop("filled_bins", "empty_bins", "sparse_bins", "status")


# ---- Folds


def _folded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    panel = adapters.panel(spark, d)
    return panel, folds.make_folds(panel)


def _fit_counts(spark: SparkSession, d: str) -> DataFrame:
    panel, made = _folded(spark, d)
    return folds.fit_counts(panel, made, [F.col("raw_probability").alias("p"), F.col("observed_outcome").alias("y")])


@query(f"WITH {sql.PANEL}, {sql.FOLDS} SELECT * FROM folds")
def d12_walkforward_folds(spark, d):
    return folds.make_folds(adapters.panel(spark, d))


@query(f"WITH {sql.ASSIGNED} SELECT fold_id, split, count(*) AS n, count(DISTINCT contract_id) AS contracts, min(forecast_ts) AS first_ts, max(forecast_ts) AS last_ts FROM assigned GROUP BY ALL")
def d13_assigned_splits(spark, d):
    return folds.split_counts(*_folded(spark, d))


@query(f"""WITH {sql.ASSIGNED}, o AS (SELECT fold_id, count(*) FILTER (k > 1) AS overlapping_rows FROM (SELECT fold_id, row_id, count(DISTINCT split) AS k FROM assigned GROUP BY ALL) GROUP BY fold_id)
SELECT fold_id, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'validation') AS validation_rows, count(*) FILTER (split = 'test') AS test_rows,
max(forecast_ts) FILTER (split = 'train') < min(forecast_ts) FILTER (split = 'validation') AND max(forecast_ts) FILTER (split = 'validation') < min(forecast_ts) FILTER (split = 'test') AS ordered, any_value(overlapping_rows) AS overlapping_rows FROM assigned JOIN o USING (fold_id) GROUP BY fold_id""")
def a24_split_integrity(spark, d):
    return folds.integrity(*_folded(spark, d))


@query(f"WITH {sql.ASSIGNED} SELECT fold_id, event_family_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM assigned GROUP BY ALL HAVING count(DISTINCT split) > 1")
def a25_family_leakage(spark, d):
    return folds.leakage(*_folded(spark, d))


_OVERLAP_SQL = "fit AS (SELECT fold_id, event_family_id, count(*) AS fit_rows FROM assigned WHERE split <> 'test' AND resolution_ts <= test_start GROUP BY ALL), test AS (SELECT fold_id, event_family_id, count(*) AS test_rows FROM assigned WHERE split = 'test' GROUP BY ALL)"


@query(f"WITH {sql.ASSIGNED}, {_OVERLAP_SQL} SELECT * FROM fit JOIN test USING (fold_id, event_family_id)")
def j22_family_overlap(spark, d):
    panel, made = _folded(spark, d)
    return folds.family_overlap(panel, made)


@query(f"WITH {sql.ASSIGNED} SELECT fold_id, count(*) AS rows, count(*) FILTER (resolution_ts > test_start) AS excluded_future_labels FROM assigned WHERE split <> 'test' GROUP BY ALL")
def d14_excluded_future_labels(spark, d):
    panel, made = _folded(spark, d)
    return walkforward.excluded_future_labels(panel, made)


# ---- Calibrators and walk-forward

_FIT_SQL = sql.ASSIGNED + """, runs AS (SELECT fold_id, least(greatest(raw_probability::DOUBLE, 0.001), 0.999) AS p, observed_outcome AS y, count(*) AS n FROM assigned WHERE split <> 'test' AND resolution_ts <= test_start GROUP BY ALL)"""
_BINNED_SQL = _FIT_SQL + """, b AS (SELECT fold_id, sum(n) AS total, sum(n * y) / sum(n) AS rate FROM runs GROUP BY ALL), c AS (SELECT fold_id, least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, sum(n) AS n, sum(n * y) AS s FROM runs GROUP BY ALL),
v AS (SELECT b.fold_id, e.bin, coalesce(n, 0) + 10.0::DOUBLE AS w, least(greatest((coalesce(s, 0) + 10.0::DOUBLE * rate) / (coalesce(n, 0) + 10.0::DOUBLE), 0.001), 0.999) AS v FROM b CROSS JOIN (SELECT unnest(range(10)) AS bin) e LEFT JOIN c ON c.fold_id = b.fold_id AND c.bin = e.bin),
seg AS (SELECT a.fold_id, a.bin AS lo, z.bin AS hi, sum(m.w * m.v) / sum(m.w) AS avg FROM v a JOIN v z ON z.fold_id = a.fold_id AND z.bin >= a.bin JOIN v m ON m.fold_id = a.fold_id AND m.bin BETWEEN a.bin AND z.bin GROUP BY ALL),
levels AS (SELECT fold_id, i AS bin, max(lowest) AS level FROM (SELECT fold_id, lo, i, min(avg) AS lowest FROM seg, (SELECT unnest(range(10)) AS i) WHERE lo <= i AND hi >= i GROUP BY ALL) GROUP BY ALL)"""


@query(
    f"""WITH {_BINNED_SQL}, k AS (SELECT fold_id, 10 - count(*) AS empty_bins, count(*) FILTER (n < 300) AS sparse_bins FROM c GROUP BY ALL)
SELECT fold_id, CAST(bin AS INTEGER) AS bin, {r('level')} AS level, CAST(coalesce(n, 0) AS BIGINT) AS bin_count, CAST(empty_bins AS INTEGER) AS empty_bins, CAST(sparse_bins AS INTEGER) AS sparse_bins,
CASE WHEN sparse_bins > 0 THEN 'fitted_with_sparse_bins' ELSE 'fitted' END AS status FROM levels LEFT JOIN c USING (fold_id, bin) JOIN k USING (fold_id)"""
)
def m7_binned_reliability(spark, d):
    """With a limit for sparse bins that the first folds don't reach."""
    fit = calibration.fit_binned(_fit_counts(spark, d), ["fold_id"], min_rows=0, min_bin_count=300)
    each = fit.select("fold_id", "status", "bin_counts", "empty_bins", "sparse_bins", F.posexplode("levels").alias("bin", "level"))
    return each.select("fold_id", "bin", "level", F.get("bin_counts", F.col("bin")).alias("bin_count"), "empty_bins", "sparse_bins", "status")


_ISOTONIC_SQL = _FIT_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY p, y) AS i, sum(n) OVER w AS cn, sum(n * y) OVER w AS cs FROM runs WINDOW w AS (PARTITION BY fold_id ORDER BY p, y)),
seg AS (SELECT a.fold_id, a.i AS lo, z.i AS hi, (z.cs - a.cs + a.n * a.y) / (z.cn - a.cn + a.n) AS avg FROM o a JOIN o z ON z.fold_id = a.fold_id AND z.i >= a.i),
low AS (SELECT fold_id, lo, hi AS i, min(avg) OVER (PARTITION BY fold_id, lo ORDER BY hi DESC) AS lowest FROM seg), levels AS (SELECT fold_id, i, max(lowest) AS level FROM low GROUP BY ALL),
fitted AS (SELECT DISTINCT fold_id, p, first_value(level) OVER (PARTITION BY fold_id, p ORDER BY i) AS level FROM o JOIN levels USING (fold_id, i))"""


@query(f"WITH {_ISOTONIC_SQL} SELECT fold_id, {r('p')} AS p, {r('least(greatest(level, 0.001), 0.999)')} AS prediction FROM fitted")
def m6_isotonic(spark, d):
    data = materialize(_fit_counts(spark, d), "fit-counts")
    points = data.select("fold_id", "p").distinct()
    found = calibration.predict_isotonic(points.join(calibration.broadcast_if_small(materialize(calibration.fit_isotonic(data, ["fold_id"]), "isotonic")), "fold_id"), p="p")
    return found.select("fold_id", "p", "prediction")


@query()
def m2_platt(spark, d):
    return calibration.fit_logistic(_fit_counts(spark, d), ["fold_id"]).select("fold_id", "rows", "status", F.col("c")[0].alias("intercept"), F.col("c")[1].alias("slope"))


@query()
def m3_beta(spark, d):
    return calibration.fit_logistic(_fit_counts(spark, d), ["fold_id"], "beta").select("fold_id", "rows", "status", *[F.col("c")[k].alias(f"c{k}") for k in range(3)])


@query()
def m5_calibration_diagnostic(spark, d):
    rows = calibration.compress(_predictions(spark, d), ["model_name", "horizon_name"], p="predicted_probability")
    return calibration.diagnostic(rows, ["model_name", "horizon_name"])


@query()
def m8_hierarchical(spark, d):
    panel, made = _folded(spark, d)
    found = walkforward.evaluate(panel, made, ("raw", "hierarchical_eb"), counted=True)
    return walkforward.fold_metrics(found)


def _walkforward(spark: SparkSession, d: str, models: tuple[str, ...] = ("raw", "binned_reliability"), counted: bool = False) -> DataFrame:
    panel, made = _folded(spark, d)
    return walkforward.evaluate(panel, made, models, counted=counted)


_WALK_SQL = f"""WITH {_BINNED_SQL}, walk AS (
  SELECT a.fold_id, a.row_id, 'raw' AS model_name, least(greatest(raw_probability::DOUBLE, 0.001), 0.999) AS q, observed_outcome AS y FROM assigned a WHERE split = 'test'
  UNION ALL SELECT a.fold_id, a.row_id, 'binned_reliability', CASE WHEN b.total >= 20 THEN least(greatest(level, 0.001), 0.999) ELSE least(greatest(raw_probability::DOUBLE, 0.001), 0.999) END, observed_outcome FROM assigned a LEFT JOIN b USING (fold_id) LEFT JOIN levels l ON l.fold_id = a.fold_id AND l.bin = least(CAST(floor(raw_probability * 10) AS INTEGER), 9) WHERE split = 'test'
), fm AS (SELECT fold_id, model_name, count(*) AS row_count, avg(power(q - y, 2)) AS b, avg(-(y * ln(least(greatest(q, 0.001), 0.999)) + (1 - y) * ln(1 - least(greatest(q, 0.001), 0.999)))) AS l FROM walk GROUP BY ALL) """


@query(_WALK_SQL + f"SELECT fold_id, model_name, row_count, {r('b')} AS mean_brier, {r('l')} AS mean_log_loss FROM fm")
def d14_walkforward_fold_metrics(spark, d):
    return walkforward.fold_metrics(_walkforward(spark, d, counted=True))


@query(_WALK_SQL + f"""SELECT 'fold_macro' AS aggregation, model_name, CAST(sum(row_count) AS BIGINT) AS row_count, {r('avg(b)')} AS mean_brier, {r('avg(l)')} AS mean_log_loss, count(DISTINCT fold_id) AS folds FROM fm GROUP BY model_name
UNION ALL SELECT 'pooled', model_name, CAST(sum(row_count) AS BIGINT), {r('sum(b * row_count) / sum(row_count)')}, {r('sum(l * row_count) / sum(row_count)')}, NULL FROM fm GROUP BY model_name""")
def a14_aggregate_metrics(spark, d):
    return walkforward.aggregate_metrics(_walkforward(spark, d, counted=True))


@query(_WALK_SQL + f"SELECT f.fold_id, f.model_name, f.row_count, {r('r.b - f.b')} AS gain FROM fm f JOIN fm r ON r.fold_id = f.fold_id AND r.model_name = 'raw' WHERE f.model_name <> 'raw'")
def d38_gain_over_time(spark, d):
    return walkforward.gain_over_time(_walkforward(spark, d, counted=True))


@query(f"""WITH {sql.PREDICTIONS}, d AS (SELECT fold_id, row_id, model_name FROM predictions WHERE NOT (model_name = 'sharp' AND cumulative_volume = 3) UNION ALL SELECT fold_id, row_id, model_name FROM predictions WHERE model_name = 'raw' AND cumulative_volume = 5),
k AS (SELECT fold_id, row_id, count(DISTINCT model_name) AS k, count(*) AS n FROM d GROUP BY ALL) SELECT fold_id, count(*) AS rows, (SELECT count(DISTINCT model_name) FROM d) AS models, count(*) FILTER (k <> (SELECT count(DISTINCT model_name) FROM d) OR n <> k) AS bad_rows FROM k GROUP BY fold_id""")
def d15_identical_test_rows(spark, d):
    """Over predictions of which some rows lack a model and others have one twice."""
    rows = adapters.predictions(spark, d).select("fold_id", "row_id", "model_name", "cumulative_volume")
    damaged = rows.where(~((F.col("model_name") == "sharp") & (F.col("cumulative_volume") == 3)))
    return walkforward.identical_rows(damaged.unionByName(rows.where("model_name = 'raw' AND cumulative_volume = 5")))


@query()
def d14_walkforward_all_models(spark, d):
    return walkforward.aggregate_metrics(_walkforward(spark, d, ("raw", "platt", "beta", "isotonic", "binned_reliability", "hierarchical_eb"), counted=True))


# ---- Inference


_INFERENCE_GROUPINGS = {"overall": [], "horizon": ["horizon_name"], "domain": ["domain"], "category": ["category"], "liquidity": ["liquidity_bucket"], "staleness": ["staleness_bucket"]}


def _with_buckets(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "liquidity_bucket": expr.left_closed_bucket(F.col("liquidity"), [20000.0, 50000.0], ["low", "medium", "high"]),
        "staleness_bucket": expr.left_closed_bucket(F.col("staleness_seconds"), [600.0, 1800.0, 3600.0], ["fresh", "recent", "old", "stale"]),
    })


def _inference_rows(spark: SparkSession, d: str) -> DataFrame:
    return _with_buckets(_predictions(spark, d))


def _inference(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_groupings(_inference_rows(spark, d), _INFERENCE_GROUPINGS)


_INFERENCE = sql.PREDICTIONS + """, ig AS (SELECT *, 'overall' AS grouping_name, 'all' AS group_key FROM predictions UNION ALL SELECT *, 'horizon', coalesce(horizon_name, '<missing>') FROM predictions
  UNION ALL SELECT *, 'domain', coalesce(domain, '<missing>') FROM predictions UNION ALL SELECT *, 'category', coalesce(category, '<missing>') FROM predictions
  UNION ALL SELECT *, 'liquidity', CASE WHEN liquidity IS NULL THEN 'missing' WHEN liquidity < 20000 THEN 'low' WHEN liquidity < 50000 THEN 'medium' ELSE 'high' END FROM predictions
  UNION ALL SELECT *, 'staleness', CASE WHEN staleness_seconds IS NULL THEN 'missing' WHEN staleness_seconds < 600 THEN 'fresh' WHEN staleness_seconds < 1800 THEN 'recent' WHEN staleness_seconds < 3600 THEN 'old' ELSE 'stale' END FROM predictions),
stats AS (SELECT model_name, grouping_name, group_key, event_family_id AS cluster, count(*) AS n, sum(brier) AS b, sum(log_loss) AS l FROM ig GROUP BY ALL)"""
_POISSON = "CASE " + " ".join(f"WHEN u < {x!r} THEN {k}" for k, x in enumerate([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712])) + " ELSE 7 END"
_DRAWN = f"""reps AS (SELECT CAST(unnest(range(1000)) AS INTEGER) AS replicate), drawn AS (SELECT *, {_POISSON} AS w FROM (SELECT cluster, replicate, CAST('0x' || substr(md5(cluster || '|' || replicate), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT cluster FROM stats), reps))"""


@query(f"WITH {_INFERENCE} SELECT model_name, grouping_name, group_key, cluster, n, {r('b')} AS brier, {r('l')} AS log_loss FROM stats")
def a30_cluster_statistics(spark, d):
    return inference.cluster_stats(_inference(spark, d))


@query(f"WITH {_INFERENCE} SELECT model_name, grouping_name, group_key, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS rows, {r('sum(n)::DOUBLE * sum(n) / sum(n * n)')} AS effective_clusters FROM stats GROUP BY ALL")
def a31_kish_clusters(spark, d):
    return inference.kish(inference.cluster_stats(_inference(spark, d)))


@query(f"WITH {_INFERENCE}, {_DRAWN} SELECT model_name, grouping_name, group_key, replicate, {r('sum(w * b) / nullif(sum(w * n), 0)')} AS brier, {r('sum(w * l) / nullif(sum(w * n), 0)')} AS log_loss FROM stats JOIN drawn USING (cluster) GROUP BY ALL")
def d17_bootstrap_replicates(spark, d):
    return inference.bootstrap_means(inference.cluster_stats(_inference(spark, d)))


@query(f"""WITH {_INFERENCE}, {_DRAWN}, m AS (SELECT model_name, grouping_name, group_key, replicate, sum(w * b) / nullif(sum(w * n), 0) AS brier, sum(w * l) / nullif(sum(w * n), 0) AS log_loss FROM stats JOIN drawn USING (cluster) GROUP BY ALL),
e AS (SELECT model_name, grouping_name, group_key, sum(n) AS rows, count(*) AS clusters, sum(b) / sum(n) AS brier, sum(l) / sum(n) AS log_loss FROM stats GROUP BY ALL),
q AS (SELECT model_name, grouping_name, group_key, quantile_cont(brier, [0.025, 0.975]) AS brier, quantile_cont(log_loss, [0.025, 0.975]) AS log_loss FROM m GROUP BY ALL)
SELECT model_name, grouping_name, group_key, CAST(rows AS BIGINT) AS rows, clusters, CASE WHEN rows < 30 THEN 'too_few_rows' WHEN clusters < 5 THEN 'too_few_clusters' ELSE 'ok' END AS status, metric, {r('estimate')} AS estimate, CASE WHEN rows >= 30 AND clusters >= 5 THEN {r('ci[1]')} END AS low, CASE WHEN rows >= 30 AND clusters >= 5 THEN {r('ci[2]')} END AS high FROM (
  SELECT e.model_name, e.grouping_name, e.group_key, rows, clusters, 'brier' AS metric, e.brier AS estimate, q.brier AS ci FROM e JOIN q USING (model_name, grouping_name, group_key)
  UNION ALL SELECT e.model_name, e.grouping_name, e.group_key, rows, clusters, 'log_loss', e.log_loss, q.log_loss FROM e JOIN q USING (model_name, grouping_name, group_key))""")
def d16_score_intervals(spark, d):
    stats = materialize(inference.cluster_stats(_inference(spark, d)), "cluster-stats")
    return inference.intervals(inference.bootstrap_means(stats), stats)


_PAIRED = _INFERENCE + """, pairs AS (SELECT a.model_name, a.grouping_name, a.group_key, a.event_family_id AS cluster, count(*) AS n, sum(a.brier - b.brier) AS b, sum(a.log_loss - b.log_loss) AS l FROM ig a JOIN ig b ON b.row_id = a.row_id AND b.grouping_name = a.grouping_name AND b.group_key = a.group_key AND b.model_name = 'raw' WHERE a.model_name <> 'raw' GROUP BY ALL)"""


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Without the check that rows pair one to one: lineitem has a row twice at the smallest size."""
    return inference.paired_stats(_inference_rows(spark, d), one_to_one=False, groupings=_INFERENCE_GROUPINGS)


@query(f"WITH {_PAIRED} SELECT model_name, grouping_name, group_key, cluster, n, {r('b')} AS brier, {r('l')} AS log_loss FROM pairs")
def j21_paired_cluster_deltas(spark, d):
    return _paired(spark, d)


@query(f"WITH {_PAIRED}, x AS (SELECT model_name, grouping_name, group_key, count(*) AS clusters, avg(b / n) AS mean, stddev_samp(b / n) / sqrt(count(*)) AS se FROM pairs GROUP BY ALL) SELECT model_name, grouping_name, group_key, clusters, {r('mean')} AS mean, {r('se')} AS standard_error, {r('mean / se')} AS z FROM x")
def a32_paired_diagnostics(spark, d):
    return inference.paired_diagnostics(_paired(spark, d))


@query(f"""WITH {_PAIRED}, {_DRAWN}, m AS (SELECT model_name, grouping_name, group_key, replicate, sum(w * b) / nullif(sum(w * n), 0) AS brier, sum(w * l) / nullif(sum(w * n), 0) AS log_loss FROM pairs JOIN drawn USING (cluster) GROUP BY ALL),
e AS (SELECT model_name, grouping_name, group_key, sum(b) / sum(n) AS brier, sum(l) / sum(n) AS log_loss FROM pairs GROUP BY ALL),
t AS (SELECT model_name, grouping_name, group_key, 'brier' AS metric, any_value(e.brier) AS estimate, avg(CASE WHEN e.brier > 0 THEN m.brier <= 0 ELSE m.brier >= 0 END::INT) AS tail FROM m JOIN e USING (model_name, grouping_name, group_key) GROUP BY ALL
  UNION ALL SELECT model_name, grouping_name, group_key, 'log_loss', any_value(e.log_loss), avg(CASE WHEN e.log_loss > 0 THEN m.log_loss <= 0 ELSE m.log_loss >= 0 END::INT) FROM m JOIN e USING (model_name, grouping_name, group_key) GROUP BY ALL),
p AS (SELECT *, least(1.0, 2 * tail) AS pv FROM t), k AS (SELECT *, row_number() OVER (ORDER BY pv, model_name, grouping_name, group_key, metric) AS rank, count(*) OVER () AS m FROM p)
SELECT model_name, grouping_name, group_key, metric, {r('estimate')} AS estimate, {r('pv')} AS p_value, {r('least(1.0, min(pv * m / rank) OVER (ORDER BY rank DESC))')} AS q_value FROM k""")
def w10_benjamini_hochberg(spark, d):
    paired = materialize(_paired(spark, d), "paired")
    return inference.benjamini_hochberg(inference.sign_p_values(inference.bootstrap_means(paired), paired))


@query(f"""WITH {_INFERENCE}, {_DRAWN}, cells AS (SELECT model_name, grouping_name, group_key, event_family_id AS cluster, least(CAST(floor(predicted_probability * 10) AS INTEGER), 9) AS bin, count(*) AS n, sum(predicted_probability) AS sp, sum(observed_outcome) AS sy FROM ig GROUP BY ALL),
x AS (SELECT model_name, grouping_name, group_key, replicate, bin, sum(w * n) AS n, abs(sum(w * sp) - sum(w * sy)) AS gap FROM cells JOIN drawn USING (cluster) GROUP BY ALL) SELECT model_name, grouping_name, group_key, replicate, {r('sum(gap) / nullif(sum(n), 0)')} AS ece FROM x GROUP BY ALL""")
def d18_bootstrap_ece(spark, d):
    return inference.bootstrap_ece(inference.bin_stats(_inference_rows(spark, d), groupings=_INFERENCE_GROUPINGS))


# ---- Edge


def _edge(spark: SparkSession, d: str) -> DataFrame:
    return edge.simulate(adapters.predictions(spark, d))


@query(f"WITH {sql.EDGE} SELECT model_name, row_id, friction_tier, 'YES' AS trade_side, fee_name, {r('fee_cost')} AS fee_cost, {r('effective_cost')} AS effective_cost, {r('net_edge')} AS net_edge, net_edge >= 0.02 AS passes_threshold, {r('realized')} AS realized_net FROM edge")
def d22_edge_candidates(spark, d):
    return _edge(spark, d).select("model_name", "row_id", "friction_tier", "trade_side", "fee_name", "fee_cost", "effective_cost", "net_edge", "passes_threshold", "realized_net")


@query(f"""WITH {sql.EDGE} SELECT model_name, friction_tier, 'YES' AS trade_side, count(*) AS candidates, count(*) FILTER (net_edge >= 0.02) AS selected, {r('avg((net_edge >= 0.02)::INT)')} AS selected_share, {r('avg(net_edge)')} AS mean_net_edge, {r('median(net_edge)')} AS median_net_edge, {r('avg(effective_cost)')} AS mean_cost,
{r('avg(net_edge) FILTER (net_edge >= 0.02)')} AS selected_mean_net_edge, {r('avg(realized) FILTER (net_edge >= 0.02)')} AS selected_mean_realized, {r('sum(realized) FILTER (net_edge >= 0.02)')} AS selected_total FROM edge GROUP BY ALL""")
def a26_edge_tier_summary(spark, d):
    return edge.tier_summary(edge.simulate_counts(adapters.predictions(spark, d)), weight="n")


@query(f"WITH {sql.EDGE} SELECT model_name, friction_tier, count(*) FILTER (net_edge >= 0.02) AS selected, count(*) FILTER (net_edge >= 0.02 AND cumulative_volume >= 3) AS selected_with_volume, CAST(coalesce(sum(cumulative_volume) FILTER (net_edge >= 0.02), 0) AS BIGINT) AS selected_volume FROM edge GROUP BY ALL")
def a27_capacity_summary(spark, d):
    return edge.capacity_summary(_edge(spark, d))


@query(f"WITH {sql.EDGE} SELECT f.fee_name, {r('f.fee_rate')} AS fee_rate, count(e.row_id) AS n FROM (VALUES ('early', 0.07), ('late', 0.05)) f(fee_name, fee_rate) LEFT JOIN edge e ON e.fee_name = f.fee_name GROUP BY ALL")
def a29_fee_schedule_audit(spark, d):
    return edge.fee_audit(_edge(spark, d), edge.EdgeConfig().schedule)


_PNL_SQL = f"WITH {sql.EDGE}, pnl AS (SELECT model_name, friction_tier, 'YES' AS trade_side, forecast_ts, row_id, realized, sum(realized) OVER (PARTITION BY model_name, friction_tier ORDER BY forecast_ts, row_id ROWS UNBOUNDED PRECEDING) AS c FROM edge WHERE net_edge >= 0.02) "


@query(_PNL_SQL + f"SELECT model_name, friction_tier, trade_side, forecast_ts, row_id, {r('realized')} AS realized_total, round(c, 4) + 0.0 AS cumulative FROM pnl")
def w8_cumulative_pnl(spark, d):
    return edge.cumulative_pnl(_edge(spark, d)).withColumn("cumulative", F.round("cumulative", 4))


@query(_PNL_SQL + "SELECT model_name, friction_tier, trade_side, round(arg_max(c, (forecast_ts, row_id)), 4) + 0.0 AS final FROM pnl GROUP BY ALL")
def a34_final_pnl(spark, d):
    return reports.final_pnl(edge.cumulative_pnl(_edge(spark, d))).withColumn("final", F.round("final", 4))


_STRICT = edge.EdgeConfig(max_staleness=3000.0, min_liquidity=20000.0, min_volume=2.0, min_price=0.05, max_price=0.95)


@query(f"""WITH {sql.PREDICTIONS}, t AS (SELECT *, concat_ws(';', CASE WHEN staleness_seconds IS NULL THEN 'missing_staleness' END, CASE WHEN staleness_seconds > 3000 THEN 'stale_price' END, CASE WHEN liquidity IS NULL THEN 'missing_liquidity_proxy' END, CASE WHEN liquidity < 20000 THEN 'low_liquidity_proxy' END, CASE WHEN cumulative_volume < 2 THEN 'low_cumulative_volume' END) AS reason FROM predictions),
s AS (SELECT concat_ws(';', CASE WHEN raw_probability < 0.05 THEN 'entry_price_below_min' END, CASE WHEN raw_probability > 0.95 THEN 'entry_price_above_max' END) AS reason FROM t, (VALUES (1), (2), (3)) WHERE reason = '')
SELECT reason AS exclusion_reason, count(*) AS n FROM (SELECT reason FROM t UNION ALL SELECT reason FROM s) WHERE reason <> '' GROUP BY 1""")
def a28_edge_exclusions(spark, d):
    return edge.excluded(adapters.predictions(spark, d), _STRICT)


_QUOTED_SQL = f"""WITH {_QUOTES}, {sql.CONTRACTS}, f AS (SELECT contract_id, resolution_ts - INTERVAL 1 DAY AS forecast_ts FROM contracts), q AS (
  SELECT f.contract_id, f.forecast_ts, q.quote_ts, q.yes_bid, q.yes_ask, q.no_bid, q.no_ask, row_number() OVER (PARTITION BY f.contract_id ORDER BY q.quote_ts DESC, q.yes_ask DESC, q.yes_bid DESC) AS rn FROM f LEFT JOIN quotes q ON q.contract_id = f.contract_id AND q.quote_ts <= f.forecast_ts) """


@query(_QUOTED_SQL + f"SELECT contract_id, forecast_ts, quote_ts, {r('yes_bid')} AS yes_bid, {r('yes_ask')} AS yes_ask, {r('no_bid')} AS no_bid, {r('no_ask')} AS no_ask, {r('(epoch_us(forecast_ts) - epoch_us(quote_ts)) / 1e6')} AS quote_staleness_seconds FROM q WHERE rn = 1")
def j20_asof_quotes(spark, d):
    rows = adapters.contracts(spark, d).select("contract_id", F.expr("resolution_ts - interval 1 day").alias("forecast_ts"))
    return edge.asof_quotes(rows, cleaning.normalize_quotes(adapters.raw_quotes(spark, d)))


# ---- Robustness and audits of raw prices


@query(f"WITH {sql.PREDICTIONS} SELECT model_name, snapshot_method, count(*) AS row_count, {r('avg(brier)')} AS mean_brier, {r('avg(log_loss)')} AS mean_log_loss FROM predictions GROUP BY ALL")
def d26_method_slices(spark, d):
    return robustness.method_slices(_predictions(spark, d))


def _grid_sql(column: str, op: str, limits: list[tuple[str, float]]) -> str:
    values = ", ".join(f"('{n}', {x})" for n, x in limits)
    return f"""WITH {sql.PREDICTIONS}, g(filter_name, x) AS (VALUES {values}) SELECT m.model_name, g.filter_name, count(p.row_id) AS row_count, {r('avg(brier)')} AS mean_brier, {r('avg(log_loss)')} AS mean_log_loss, CASE WHEN count(p.row_id) = 0 THEN 'empty_after_filter' ELSE 'ok' END AS status
FROM (SELECT DISTINCT model_name FROM predictions) m CROSS JOIN g LEFT JOIN predictions p ON p.model_name = m.model_name AND p.{column} {op} g.x GROUP BY m.model_name, g.filter_name"""


@query(_grid_sql("liquidity", ">=", [("liquidity>=0", 0), ("liquidity>=20000", 20000), ("liquidity>=60000", 60000), ("liquidity>=1e+09", 1e9)]))
def d27_liquidity_filters(spark, d):
    return robustness.liquidity_filters(_predictions(spark, d))


@query(_grid_sql("staleness_seconds", "<=", [("staleness<=3600", 3600), ("staleness<=1800", 1800), ("staleness<=600", 600), ("staleness<=-1", -1)]))
def d27_staleness_filters(spark, d):
    return robustness.staleness_filters(_predictions(spark, d))


@query(f"""WITH {sql.ASSIGNED}, predictions AS{sql.PREDICTIONS.split(', predictions AS', 1)[1]}, torn AS (SELECT fold_id, event_family_id FROM assigned GROUP BY ALL HAVING count(DISTINCT split) > 1 AND bool_or(split = 'test'))
SELECT model_name, 'all' AS variant, count(*) AS row_count, {r('avg(brier)')} AS mean_brier, {r('avg(log_loss)')} AS mean_log_loss FROM predictions GROUP BY ALL
UNION ALL SELECT model_name, 'purged', count(*), {r('avg(brier)')}, {r('avg(log_loss)')} FROM predictions p WHERE NOT EXISTS (FROM torn t WHERE t.fold_id = p.fold_id AND t.event_family_id = p.event_family_id) GROUP BY ALL""")
def d29_family_purge(spark, d):
    return robustness.family_purge(_predictions(spark, d), *_folded(spark, d))


_RULES_SQL = {"no_sports": "is_sports", "no_ambiguous": "taxonomy_ambiguous", "no_low_confidence": "taxonomy_confidence = 'low'", "no_unknown": "coalesce(domain, 'unknown') = 'unknown'", "no_politics": "coalesce(domain = 'politics', false)", "strict": "is_sports OR taxonomy_ambiguous OR taxonomy_confidence = 'low'"}


@query(f"WITH {sql.PREDICTIONS} " + " UNION ALL ".join(f"SELECT model_name, '{n}' AS filter_name, count(*) FILTER (NOT ({c})) AS row_count, {r(f'avg(brier) FILTER (NOT ({c}))')} AS mean_brier, {r(f'avg(log_loss) FILTER (NOT ({c}))')} AS mean_log_loss, count(*) FILTER ({c}) AS excluded, CASE WHEN count(*) FILTER ({c}) = 0 THEN 'not_applicable' ELSE 'ok' END AS status FROM predictions GROUP BY model_name" for n, c in _RULES_SQL.items()))
def d30_domain_exclusions(spark, d):
    return robustness.domain_exclusions(_predictions(spark, d))


def _friction_sql() -> str:
    cost = "(entry_price + x.rate * entry_price * (1 - entry_price) + spread + slippage)"
    full = f"({cost} + {cost} * 0.05::DOUBLE * holding_seconds / (365 * 86400.0::DOUBLE))"
    return f"""WITH {sql.EDGE}, x(rate) AS (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.07::DOUBLE), (0.1::DOUBLE)), y(edge) AS (VALUES (0.01::DOUBLE), (0.02::DOUBLE)), z AS (SELECT model_name, friction_tier, x.rate AS fee_rate, y.edge AS min_net_edge, predicted_probability - {full} AS net_edge, observed_outcome - {full} AS realized, {full} AS ec FROM costs, x, y)
SELECT model_name, friction_tier, 'YES' AS trade_side, {r('fee_rate')} AS fee_rate, {r('min_net_edge')} AS min_net_edge, count(*) AS candidates, count(*) FILTER (net_edge >= min_net_edge) AS selected, {r('avg((net_edge >= min_net_edge)::INT)')} AS selected_share, {r('avg(net_edge)')} AS mean_net_edge, {r('median(net_edge)')} AS median_net_edge, {r('avg(ec)')} AS mean_cost,
{r('avg(net_edge) FILTER (net_edge >= min_net_edge)')} AS selected_mean_net_edge, {r('avg(realized) FILTER (net_edge >= min_net_edge)')} AS selected_mean_realized, {r('sum(realized) FILTER (net_edge >= min_net_edge)')} AS selected_total FROM z GROUP BY ALL"""


@query(_friction_sql())
def d31_friction_scenarios(spark, d):
    return robustness.friction_scenarios(adapters.predictions(spark, d))


@query(f"""WITH {sql.PANEL}, q AS (SELECT horizon_name, count(*) AS row_count, quantile_cont(staleness_seconds, [0.5, 0.75, 0.9, 0.95, 0.99]) AS q, avg((staleness_seconds > 300)::INT) AS a, avg((staleness_seconds > 1800)::INT) AS b, avg((staleness_seconds > 3600)::INT) AS c FROM panel WHERE staleness_seconds IS NOT NULL GROUP BY ALL)
SELECT horizon_name, row_count, {r('q[1]')} AS median, {r('q[2]')} AS p75, {r('q[3]')} AS p90, {r('q[4]')} AS p95, {r('q[5]')} AS p99, {r('a')} AS share_above_300, {r('b')} AS share_above_1800, {r('c')} AS share_above_3600 FROM q""")
def a16_staleness_percentiles(spark, d):
    return raw_audit.staleness_table(adapters.panel(spark, d))


@query(f"WITH {sql.PANEL}, c AS (SELECT horizon_name, snapshot_method, count(*) AS n FROM panel GROUP BY ALL) SELECT *, {r('n / sum(n) OVER (PARTITION BY horizon_name)')} AS share FROM c")
def a17_method_mix(spark, d):
    return raw_audit.method_mix(adapters.panel(spark, d))


@query(f"WITH {sql.PANEL} SELECT observed_outcome, count(*) AS row_count, {r('min(raw_probability)')} AS least, {r('max(raw_probability)')} AS most, {r('avg(raw_probability)')} AS mean, count(*) FILTER (NOT raw_probability BETWEEN 0 AND 1) AS bad FROM panel GROUP BY ALL")
def a18_orientation(spark, d):
    return raw_audit.orientation(adapters.panel(spark, d))


@query(f"WITH {sql.PANEL}, g AS (SELECT horizon_name, date_diff('microsecond', forecast_ts, resolution_ts) / 1e6 AS gap FROM panel) SELECT horizon_name, {r('median(gap)')} AS median_gap, {r('quantile_cont(gap, 0.9)')} AS p90_gap, {r('avg((gap <= 86400)::INT)')} AS share_within_day FROM g GROUP BY ALL")
def a19_resolution_gaps(spark, d):
    return raw_audit.resolution_gaps(adapters.panel(spark, d))


@query(f"WITH {sql.with_policy(2592000, 21600)} SELECT horizon, count(*) AS n FROM snapshots WHERE contract_id IN (SELECT contract_id FROM snapshots GROUP BY contract_id HAVING count(DISTINCT horizon) = (SELECT count(DISTINCT horizon) FROM snapshots)) GROUP BY horizon")
def j25_balanced_subset(spark, d):
    """Over snapshots with one overriding staleness for all horizons."""
    panel = snapshots.snapshot_panel(adapters.contracts(spark, d), adapters.prices(spark, d), snapshots.override(HORIZONS, max_staleness="30d"))
    return raw_audit.balanced(panel).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {sql.PANEL} SELECT row_id, {r('staleness_seconds')} AS staleness_seconds FROM panel WHERE staleness_seconds > 3000")
def o2_stale_flags(spark, d):
    return raw_audit.stale_flags(adapters.panel(spark, d)).select("row_id", "staleness_seconds")


@query(f"""WITH {sql.SNAPSHOT_PANEL}, w(w) AS (VALUES (3600), (21600), (86400), (172800)), s(max_stale) AS (VALUES (600), (3600), (21600), (86400), (259200)),
v AS (SELECT c.contract_id, c.horizon, w.w, sum(p.price * p.volume) / nullif(sum(p.volume), 0) AS p FROM candidates c JOIN prices p ON p.contract_id = c.contract_id AND p.source_ts <= c.forecast_ts, w WHERE p.source_ts >= c.forecast_ts - to_seconds(w.w) GROUP BY ALL),
o AS (SELECT contract_id, horizon, 'last_trade' AS method, price AS p FROM latest UNION ALL SELECT contract_id, horizon, 'vwap_' || w, p FROM v)
SELECT c.horizon, max_stale, o.method, count(*) AS row_count, {r("avg(power(o.p - CASE c.outcome WHEN 'yes' THEN 1 ELSE 0 END, 2))")} AS mean_brier FROM candidates c JOIN latest l USING (contract_id, horizon) JOIN o USING (contract_id, horizon), s WHERE date_diff('second', l.source_ts, c.forecast_ts) <= max_stale AND o.p IS NOT NULL GROUP BY ALL""")
def d10_strict_variants(spark, d):
    return raw_audit.strict_variants(snapshots.candidates(adapters.contracts(spark, d), HORIZONS), adapters.prices(spark, d))


# ---- Reports


@query(f"WITH {sql.PREDICTIONS}, m AS (SELECT model_name, horizon_name, avg(brier) AS b FROM predictions GROUP BY ALL) SELECT m.model_name, m.horizon_name, {r('m.b')} AS mean_brier, {r('m.b - x.b')} AS delta FROM m JOIN m x ON x.horizon_name = m.horizon_name AND x.model_name = 'raw'")
def w9_deltas_to_raw(spark, d):
    found = _predictions(spark, d).groupBy("model_name", "horizon_name").agg(F.avg("brier").alias("mean_brier"))
    return reports.with_deltas(found, ["horizon_name"])


@query(f"WITH {sql.PREDICTIONS} SELECT horizon_name, " + ", ".join(f"""{r(f"avg(brier) FILTER (model_name = '{m}')")} AS {m}""" for m in ("raw", "shrunk", "sharp")) + " FROM predictions GROUP BY ALL")
def a37_horizon_model_pivot(spark, d):
    return reports.horizon_model_pivot(_predictions(spark, d), ["raw", "shrunk", "sharp"])


@query(f"WITH {sql.PANEL} SELECT horizon_name, least(CAST(floor(raw_probability * 20) AS INTEGER), 19) AS bin, count(*) AS n FROM panel GROUP BY ALL")
def a38_probability_histogram(spark, d):
    return reports.probability_histogram(adapters.panel(spark, d))


@query(f"""WITH {sql.SCORED}, c AS (SELECT domain, bin, count(*) AS n, abs(avg(raw_probability) - avg(observed_outcome)) AS gap FROM scored GROUP BY ALL), e AS (SELECT domain, sum(n * gap) / sum(n) AS ece FROM c GROUP BY ALL),
s AS (SELECT domain, count(*) AS row_count, avg(taxonomy_ambiguous::INT) AS a, avg((taxonomy_confidence = 'low')::INT) AS l FROM scored GROUP BY ALL)
SELECT s.domain, row_count, {r('a')} AS ambiguous_share, {r('l')} AS low_confidence_share, {r('ece')} AS ece FROM s LEFT JOIN e ON e.domain IS NOT DISTINCT FROM s.domain""")
def a33_domain_reliability(spark, d):
    rows = metrics.scored(adapters.panel(spark, d))
    return reports.domain_table(rows, metrics.ece(rows, keys=["domain"]))


@query(f"WITH {sql.PANEL} SELECT domain, count(*) AS n FROM panel WHERE domain IS NOT NULL GROUP BY domain ORDER BY n DESC, domain LIMIT 6")
def o3_top_domains(spark, d):
    return reports.top_domains(adapters.panel(spark, d))


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def s9_count_rows(spark, d):
    return readers.count_rows(spark, d, ["orders", "lineitem", "events"])


@query()
def d35_final_audit(spark, d):
    predictions = adapters.predictions(spark, d)
    return audit.final_audit({
        "snapshots": _snapshots(spark, d), "features": _features(spark, d), "taxonomy": _classified(spark, d), "predictions": predictions,
        "decomposition": metrics.murphy(_predictions(spark, d), keys=["model_name"]), "edge": edge.simulate(predictions),
    })


@query()
def a35_audit_roll_up(spark, d):
    return reports.status_roll_up(d35_final_audit(spark, d))


from tidemark import catalog_checks  # noqa: E402,F401  registers its queries
