"""The SQL of the market relations, as common table expressions for the queries' SQL."""

from __future__ import annotations

CONTRACTS = """contracts AS (
  SELECT 'U' || user_id AS contract_id, 'G' || (user_id % 20) AS event_id, CASE WHEN user_id % 3 = 0 THEN 'yes' ELSE 'no' END AS outcome,
         TIMESTAMP '2023-12-01' + to_days(CAST(user_id % 30 AS INTEGER)) AS created_ts, TIMESTAMP '2023-12-15' + to_days(CAST(user_id % 10 AS INTEGER)) AS open_ts,
         TIMESTAMP '2024-01-16' + to_hours(CAST(user_id * 5 % 360 AS INTEGER)) AS resolution_ts, user_id * 3 % 100 AS volume, user_id % 50 AS open_interest
  FROM (SELECT DISTINCT user_id FROM events))"""

PRICES = """prices AS (
  SELECT event_id AS trade_id, 'U' || user_id AS contract_id, ts AS source_ts, 1 + CAST(floor(value) AS BIGINT) % 99 AS cents,
         (1 + CAST(floor(value) AS BIGINT) % 99) / 100.0 AS price, 1 + event_id % 50 AS volume FROM events)"""

HORIZONS = """horizons(horizon, horizon_seconds, max_staleness, vwap_window, prefer_vwap) AS (VALUES
  ('30d', 2592000, 604800, 21600, false), ('14d', 1209600, 604800, 21600, false), ('7d', 604800, 604800, 21600, false), ('3d', 259200, 259200, 21600, false), ('1d', 86400, 86400, 3600, true),
  ('6h', 21600, 21600, 900, true), ('1h', 3600, 3600, 300, false), ('15m', 900, 900, 300, false), ('close', 60, 300, 300, false))"""

CANDIDATES = """candidates AS (
  SELECT contract_id, event_id, outcome, resolution_ts, horizon, horizon_seconds, max_staleness, vwap_window, prefer_vwap,
         resolution_ts - to_seconds(horizon_seconds) AS forecast_ts FROM contracts, horizons)"""

# Step by step: an as-of join, a staleness filter and a window join.
SNAPSHOTS = """latest AS (
  SELECT * FROM (SELECT c.contract_id, c.horizon, p.source_ts, p.price, row_number() OVER (PARTITION BY c.contract_id, c.horizon ORDER BY p.source_ts DESC, p.trade_id DESC) AS rn
  FROM candidates c JOIN prices p ON p.contract_id = c.contract_id AND p.source_ts <= c.forecast_ts) WHERE rn = 1
), vwap AS (
  SELECT c.contract_id, c.horizon, sum(p.price * p.volume) / nullif(sum(p.volume), 0) AS vwap_price, count(*) AS vwap_trade_count, CAST(sum(p.volume) AS BIGINT) AS vwap_volume, max(p.source_ts) AS vwap_ts
  FROM candidates c JOIN prices p ON p.contract_id = c.contract_id AND p.source_ts <= c.forecast_ts AND p.source_ts >= c.forecast_ts - to_seconds(c.vwap_window) GROUP BY ALL
), snapshots AS (
  SELECT c.contract_id, c.event_id, c.outcome, CASE c.outcome WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS observed_outcome, c.horizon, c.horizon_seconds, c.forecast_ts, c.resolution_ts AS close_time, c.resolution_ts,
         CASE WHEN c.prefer_vwap AND v.vwap_trade_count IS NOT NULL THEN v.vwap_price ELSE l.price END AS snapshot_price,
         CASE WHEN c.prefer_vwap AND v.vwap_trade_count IS NOT NULL THEN 'vwap' ELSE 'last_trade' END AS snapshot_method,
         CASE WHEN c.prefer_vwap AND v.vwap_trade_count IS NOT NULL THEN v.vwap_ts ELSE l.source_ts END AS price_timestamp,
         date_diff('second', CASE WHEN c.prefer_vwap AND v.vwap_trade_count IS NOT NULL THEN v.vwap_ts ELSE l.source_ts END, c.forecast_ts) AS staleness_seconds,
         l.price AS last_trade_price, l.source_ts AS last_trade_ts, date_diff('second', l.source_ts, c.forecast_ts) AS last_trade_staleness,
         v.vwap_price, v.vwap_trade_count, v.vwap_volume, v.vwap_ts
  FROM candidates c JOIN latest l ON l.contract_id = c.contract_id AND l.horizon = c.horizon AND l.source_ts >= c.forecast_ts - to_seconds(c.max_staleness)
  LEFT JOIN vwap v ON v.contract_id = c.contract_id AND v.horizon = c.horizon)"""

MARKET = ",\n".join([CONTRACTS, PRICES, HORIZONS, CANDIDATES])
SNAPSHOT_PANEL = MARKET + ",\n" + SNAPSHOTS



def with_policy(max_staleness: int, vwap_window: int, prefer_vwap: bool = False) -> str:
    """The snapshot panel with one policy for all horizons."""
    seconds = {"30d": 2592000, "14d": 1209600, "7d": 604800, "3d": 259200, "1d": 86400, "6h": 21600, "1h": 3600, "15m": 900, "close": 60}
    rows = ", ".join(f"('{h}', {n}, {max_staleness}, {vwap_window}, {str(prefer_vwap).lower()})" for h, n in seconds.items())
    return SNAPSHOT_PANEL.replace(HORIZONS, f"horizons(horizon, horizon_seconds, max_staleness, vwap_window, prefer_vwap) AS (VALUES {rows})")


PANEL = """panel AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_id, 'C' || l_orderkey AS contract_id, 'F' || l_suppkey AS event_family_id,
         CASE l_returnflag WHEN 'A' THEN '1d' WHEN 'N' THEN '7d' WHEN 'R' THEN '6h' END AS horizon_name,
         CASE l_partkey % 4 WHEN 0 THEN 'sports' WHEN 1 THEN 'finance' WHEN 2 THEN 'weather' END AS domain, 'cat' || (l_partkey % 3) AS category,
         l_shipdate AS forecast_ts, l_shipdate + to_days(CAST(l_partkey % 45 + 1 AS INTEGER)) AS resolution_ts, (CAST(l_quantity AS BIGINT) * 2 - 1) / 100.0 AS raw_probability,
         CASE WHEN (l_orderkey * 7 + l_partkey * 13 + l_suppkey * 5 + l_linenumber) % 100 < 10 + (CAST(l_quantity AS BIGINT) * 2 - 1) * 4 / 5.0 THEN 1 ELSE 0 END AS observed_outcome,
         CAST(l_linenumber AS BIGINT) AS cumulative_volume, CASE WHEN l_partkey % 19 <> 0 THEN CAST(l_partkey * 37 % 4000 AS DOUBLE) END AS staleness_seconds,
         CASE WHEN l_partkey % 23 <> 0 THEN l_extendedprice END AS liquidity, CASE WHEN l_linenumber % 3 = 0 THEN 'vwap' ELSE 'last_trade' END AS snapshot_method,
         CASE WHEN l_partkey % 6 = 0 THEN 'low' WHEN l_partkey % 6 < 3 THEN 'medium' ELSE 'high' END AS taxonomy_confidence, l_partkey % 29 = 0 AS taxonomy_ambiguous, l_partkey % 4 = 0 AS is_sports
  FROM lineitem)"""

PREDICTIONS = PANEL + """, predictions AS (
  SELECT *, 'fold_' || strftime(forecast_ts, '%Y_%m') AS fold_id, power(predicted_probability - observed_outcome, 2) AS brier,
         -(observed_outcome * ln(least(greatest(predicted_probability, 0.001), 0.999)) + (1 - observed_outcome) * ln(1 - least(greatest(predicted_probability, 0.001), 0.999))) AS log_loss
  FROM (SELECT *, 'raw' AS model_name, CAST(raw_probability AS DOUBLE) AS predicted_probability FROM panel
        UNION ALL SELECT *, 'shrunk', CAST(raw_probability AS DOUBLE) * CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE) FROM panel
        UNION ALL SELECT *, 'sharp', least(greatest(CAST(raw_probability AS DOUBLE) * CAST(1.2 AS DOUBLE) - CAST(0.1 AS DOUBLE), 0.01), 0.99) FROM panel))"""

SCORED = PANEL + """, scored AS (
  SELECT *, power(raw_probability - observed_outcome, 2) AS brier, least(CAST(floor(raw_probability * 10) AS INTEGER), 9) AS bin,
         -(observed_outcome * ln(least(greatest(raw_probability, 0.001), 0.999)) + (1 - observed_outcome) * ln(1 - least(greatest(raw_probability, 0.001), 0.999))) AS log_loss FROM panel)"""

GROUPED = SCORED + """, grouped AS (
  SELECT *, 'overall' AS grouping_name, 'all' AS group_key FROM scored
  UNION ALL SELECT *, 'horizon', coalesce(horizon_name, '<missing>') FROM scored
  UNION ALL SELECT *, 'domain', coalesce(domain, '<missing>') FROM scored
  UNION ALL SELECT *, 'category', coalesce(category, '<missing>') FROM scored
  UNION ALL SELECT *, 'horizon_domain', coalesce(horizon_name, '<missing>') || '|' || coalesce(domain, '<missing>') FROM scored)"""

FOLDS = """months AS (SELECT DISTINCT date_trunc('month', forecast_ts) AS m FROM panel),
folds AS (
  SELECT 'fold_' || strftime(t.m, '%Y_%m') AS fold_id, (SELECT min(m) FROM months) AS train_start, t.m - INTERVAL 1 MONTH AS val_start, t.m AS test_start, t.m + INTERVAL 1 MONTH AS test_end
  FROM (SELECT CAST(unnest(generate_series((SELECT min(m) FROM months), (SELECT max(m) FROM months), INTERVAL 1 MONTH)) AS TIMESTAMP) AS m) t
  WHERE (SELECT max(forecast_ts) FROM panel) >= t.m + INTERVAL 1 MONTH AND EXISTS (FROM months WHERE m = t.m) AND EXISTS (FROM months WHERE m = t.m - INTERVAL 1 MONTH)
    AND (SELECT min(m) FROM months) < t.m - INTERVAL 1 MONTH)"""

ASSIGNED = PANEL + ", " + FOLDS + """, assigned AS (
  SELECT p.*, f.fold_id, f.test_start, CASE WHEN forecast_ts < val_start THEN 'train' WHEN forecast_ts < test_start THEN 'validation' ELSE 'test' END AS split
  FROM panel p JOIN folds f ON forecast_ts >= train_start AND forecast_ts < test_end)"""

EDGE = PREDICTIONS + """, tiers(friction_tier, spread, slippage) AS (VALUES ('fee_only', 0.0::DOUBLE, 0.0::DOUBLE), ('moderate', 0.005::DOUBLE, 0.005::DOUBLE), ('severe', 0.01::DOUBLE, 0.015::DOUBLE)),
base AS (
  SELECT *, date_diff('microsecond', forecast_ts, resolution_ts) / 1e6 AS holding_seconds, CAST(raw_probability AS DOUBLE) AS entry_price,
         CASE WHEN forecast_ts < TIMESTAMP '1998-01-01' THEN 'early' ELSE 'late' END AS fee_name, CASE WHEN forecast_ts < TIMESTAMP '1998-01-01' THEN 0.07::DOUBLE ELSE 0.05::DOUBLE END AS fee_rate FROM predictions),
costs AS (
  SELECT *, fee_rate * entry_price * (1 - entry_price) AS fee_cost, entry_price + fee_rate * entry_price * (1 - entry_price) + spread + slippage AS cost_before FROM base, tiers
  WHERE entry_price BETWEEN 0.01 AND 0.99 AND predicted_probability BETWEEN 0 AND 1),
edge AS (
  SELECT *, cost_before + cost_before * 0.05::DOUBLE * holding_seconds / (365 * 86400.0::DOUBLE) AS effective_cost, predicted_probability - entry_price AS gross_edge,
         predicted_probability - (cost_before + cost_before * 0.05::DOUBLE * holding_seconds / (365 * 86400.0::DOUBLE)) AS net_edge,
         observed_outcome - (cost_before + cost_before * 0.05::DOUBLE * holding_seconds / (365 * 86400.0::DOUBLE)) AS realized FROM costs)"""
