"""Fits, percentiles and intervals against plain numpy; checks that raise; files."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import calibration, edge, folds, inference, keys, metrics, quantiles, reports, robustness, snapshots, walkforward
from tidemark.sources import readers, sinks

EPS = 0.001


def plain_newton(p, y, kind="platt", ridge=1e-9, tolerance=1e-8, steps=100):
    """Row by row, without compression."""
    p = np.clip(np.array(p, float), EPS, 1 - EPS)
    x = np.stack([np.ones_like(p), np.log(p), np.log(1 - p)], 1) if kind == "beta" else np.stack([np.ones_like(p), np.log(p / (1 - p))], 1)
    c = np.array([0.0, 1.0, -1.0] if kind == "beta" else [0.0, 1.0])
    y = np.array(y, float)
    for k in range(1, steps + 1):
        mu = 1 / (1 + np.exp(-(x @ c)))
        w = np.maximum(mu * (1 - mu), ridge)
        delta = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(len(c)), x.T @ (y - mu))
        c = c + delta
        if np.abs(delta).max() < tolerance:
            return c, k, "converged"
    return c, steps, "max_iterations"


def groups():
    rng = random.Random(3)
    out = {"good": [], "few": [(0.4, 1), (0.6, 0)] * 3, "one_outcome": [(rng.random(), 1) for _ in range(40)], "one_price": [(0.3, k % 2) for k in range(40)], "negative": []}
    for _ in range(600):
        p = rng.choice([0.02, 0.1, 0.25, 0.5, 0.61, 0.8, 0.97])
        out["good"].append((p, int(rng.random() < 0.15 + 0.6 * p)))
        out["negative"].append((p, int(rng.random() < 0.9 - 0.7 * p)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(g, float(p), y) for g, x in groups().items() for p, y in x], "fold_id string, raw_probability double, observed_outcome int")


@pytest.mark.parametrize("kind", ["platt", "beta", "diagnostic"])
def test_newton_fits(rows, kind):
    got = {r.fold_id: r for r in calibration.fit_logistic(calibration.compress(rows, ["fold_id"]), ["fold_id"], kind, max_iterations=12).collect()}
    assert got["few"].status == "fallback_too_few_rows" and got["one_outcome"].status == "fallback_outcome_has_no_variation" and got["one_price"].status == "fallback_probability_has_no_variation"
    for name in ("good", "negative"):
        c, steps, status = plain_newton(*zip(*groups()[name], strict=True), kind, steps=12)
        if kind == "platt" and c[1] < 0:
            assert got[name].status == "fallback_negative_slope" and got[name].c is None
        else:
            assert (got[name].status, got[name].iterations) == (status, steps)
            assert np.allclose(got[name].c, c, rtol=1e-7 if status == "converged" else 1e-4, atol=1e-9)
    # A fit that runs out of steps keeps its coefficients, unless Platt's slope is negative there.
    short = calibration.fit_logistic(calibration.compress(rows, ["fold_id"]), ["fold_id"], kind, max_iterations=2).where("fold_id = 'good'").first()
    c, _, status = plain_newton(*zip(*groups()["good"], strict=True), kind, steps=2)
    assert status == "max_iterations"
    assert (short.status, short.c) == ("fallback_negative_slope", None) if kind == "platt" and c[1] < 0 else short.status == "max_iterations" and np.allclose(short.c, c)


def test_diagnostic_keeps_what_it_has_at_the_last_step(rows):
    data = calibration.compress(rows.where("fold_id <> 'negative'"), ["fold_id"])
    full = {r.fold_id: r for r in calibration.diagnostic(data, ["fold_id"]).collect()}
    assert full["good"].converged and full["good"].slope > 0 and full["few"].slope is None and full["few"].status == "too_few_rows"


def plain_isotonic(pairs):
    blocks = []
    for p, y in sorted((min(max(p, EPS), 1 - EPS), y) for p, y in pairs):
        blocks.append([p, float(y), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            e, t, w = blocks.pop()
            blocks[-1] = [e, blocks[-1][1] + t, blocks[-1][2] + w]
    return [b[0] for b in blocks], [min(max(t / w, EPS), 1 - EPS) for _, t, w in blocks]


@pytest.fixture
def ranges(spark, request):
    """So many sorted ranges, none of them put together."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("ranges", [1, 5, 30], indirect=True)
def test_isotonic_in_ranges_and_trees(spark, ranges, monkeypatch):
    monkeypatch.setattr(calibration, "FANIN", 4)
    rng = random.Random(9)
    data = {f: [(q := rng.random() ** 2, int(rng.random() < q)) for _ in range(700)] for f in ("a", "b")}
    data["b"] += [(0.5, 0), (0.5, 1), (0.5, 1), (0.0, 1), (1.0, 0)]
    data["close"] = [(0.5 + k * 1e-9, int(rng.random() < 0.3 + k / 2000)) for k in range(600)]  # prices that no grid tells apart
    df = spark.createDataFrame([(f, p, y) for f, x in data.items() for p, y in x], "fold_id string, raw_probability double, observed_outcome int")
    fits = calibration.fit_isotonic(calibration.compress(df, ["fold_id"]), ["fold_id"])
    for r in fits.collect():
        thresholds, levels = plain_isotonic(data[r.fold_id])
        # Blocks of equal means may be cut differently; what they predict is the same.
        at = lambda x, t, v: v[min(np.searchsorted(t, x), len(v) - 1)]
        for x in [0.0005, 0.5, 0.9995, *[p for p, _ in data[r.fold_id]]]:
            x = min(max(x, EPS), 1 - EPS)
            assert math.isclose(at(x, np.array(r.thresholds), r.levels), at(x, np.array(thresholds), levels), rel_tol=1e-9)
    asked = spark.createDataFrame([(f, x) for f in data for x in (0.0, 0.0004, 0.2, 0.5, 0.77, 1.0)], "fold_id string, raw_probability double")
    for r in calibration.predict_isotonic(asked.join(fits, "fold_id")).collect():
        thresholds, levels = plain_isotonic(data[r.fold_id])
        x = min(max(r.raw_probability, EPS), 1 - EPS)
        assert math.isclose(r.prediction, levels[min(np.searchsorted(thresholds, x), len(levels) - 1)], rel_tol=1e-9)


@pytest.mark.parametrize("max_state", [1 << 20, 0])
def test_hierarchical_against_numpy(spark, max_state):
    rng = random.Random(4)
    raw = []
    for _ in range(1500):
        level = rng.choice(["x", "y", "z", None])
        p = rng.choice([0.1, 0.3, 0.5, 0.8])
        raw.append(("f", p, int(rng.random() < min(0.98, p + {"x": 0.15, "y": -0.05, "z": 0.0, None: 0.0}[level])), level))
    raw += [("f", 0.5, 1, "rare")] * 5
    df = spark.createDataFrame(raw, "fold_id string, raw_probability double, observed_outcome int, domain string")
    base, offsets = calibration.fit_hierarchical(calibration.compress(df, ["fold_id"], context=("domain",)), ["fold_id"], ("domain",), max_state=max_state)
    c, _, _ = plain_newton([r[1] for r in raw], [r[2] for r in raw])
    assert np.allclose(base.first().c, c, rtol=1e-7)
    p, y = np.array([r[1] for r in raw]), np.array([r[2] for r in raw])
    eta, found = c[0] + c[1] * np.log(p / (1 - p)), {}
    for _ in range(5):
        now = dict(found)
        for level in ("x", "y", "z"):
            here = np.array([r[3] == level for r in raw])
            mu = 1 / (1 + np.exp(-(eta[here] + now.get(level, 0.0))))
            n = here.sum()
            found[level] = now.get(level, 0.0) + n / (n + 50.0) * (y[here] - mu).sum() / max((mu * (1 - mu)).sum(), 1e-9)
    got = {r.level: r.offset for r in offsets.collect()}
    assert set(got) == {"x", "y", "z"} and all(math.isclose(got[k], found[k], rel_tol=1e-6, abs_tol=1e-9) for k in got)


def test_backfitting_in_a_task_and_over_the_cluster_agree(spark):
    """Two context columns, several folds, null and small levels: the sweeps inside a task and those of Spark's aggregates."""
    rng = random.Random(12)
    raw = [(f, rng.choice([0.1, 0.4, 0.7]), int(rng.random() < 0.45), rng.choice(["x", "y", None]), rng.choice(["1d", "7d"])) for f in ("a", "b") for _ in range(500)] + [("c", 0.5, 1, "x", "1d")] * 3
    df = spark.createDataFrame(raw, "fold_id string, raw_probability double, observed_outcome int, domain string, horizon_name string")
    data = calibration.compress(df, ["fold_id"], context=("domain", "horizon_name"))
    rows = lambda n: {(r.fold_id, r.column, r.level): r.offset for r in calibration.fit_hierarchical(data, ["fold_id"], ("domain", "horizon_name"), max_state=n)[1].collect()}
    inside, outside, mixed = rows(1 << 20), rows(0), rows(8)
    assert len(inside) == 8 and set(inside) == set(outside) == set(mixed)
    assert all(math.isclose(inside[k], x[k], rel_tol=1e-9, abs_tol=1e-12) for x in (outside, mixed) for k in inside)


def test_exact_percentiles(spark):
    rng = random.Random(1)
    data = {"a": [rng.gauss(0, 5) for _ in range(60_001)], "b": [7.0] * 50, "c": [1.0], None: [rng.choice([0.0, 1.0, 1.5]) for _ in range(400)], "e": [None, 2.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in x], "k string, v double")
    points = (0.0, 0.1, 0.5, 0.95, 1.0)
    got = {(r.k, r.point): r.value for r in quantiles.exact_percentiles(df, ["k"], "v", points).collect()}
    assert len(got) == 25
    for k, x in data.items():
        for q in points:
            assert math.isclose(got[k, q], np.quantile([v for v in x if v is not None], q), rel_tol=1e-12)


def test_calibration_intervals(spark):
    rng = random.Random(6)
    raw = []
    for k in range(900):
        p = rng.choice([0.1, 0.3, 0.5, 0.7, 0.9])
        raw.append(("m", "overall", "all", f"f{k % 37}", p, int(rng.random() < 0.1 + 0.8 * p)))
    raw += [("m", "overall", "tiny", "f1", 0.5, k % 2) for k in range(3)]
    df = spark.createDataFrame(raw, "model_name string, grouping_name string, group_key string, event_family_id string, predicted_probability double, observed_outcome int")
    fits = calibration.diagnostic(calibration.compress(df, inference.GROUP, p="predicted_probability"), inference.GROUP)
    reps = inference.calibration_replicates(inference.cluster_scores(df, fits), fits, 50).collect()
    mine = [r for r in raw if r[2] == "all"]
    c, _, _ = plain_newton([r[4] for r in mine], [r[5] for r in mine])
    x = np.array([math.log(r[4] / (1 - r[4])) for r in mine])
    mu = 1 / (1 + np.exp(-(c[0] + c[1] * x)))
    y, names = np.array([r[5] for r in mine]), sorted({r[3] for r in mine})
    design = np.stack([np.ones_like(x), x], 1)
    inverse = np.linalg.inv(design.T @ (design * (mu * (1 - mu))[:, None]))
    scores = np.array([(design[[r[3] == f for r in mine]] * (y - mu)[[r[3] == f for r in mine], None]).sum(0) for f in names])
    weights = {(r.cluster, r.replicate): r.w for r in inference.draws(spark.createDataFrame([(f,) for f in names], "cluster string"), 50).collect()}
    assert 0.8 < np.mean(list(weights.values())) < 1.2
    for r in reps:
        w = np.array([weights[f, r.replicate] for f in names])
        assert np.allclose([r.calibration_intercept, r.calibration_slope], c + inverse @ ((w - 1) @ scores), rtol=1e-6, atol=1e-8)
    out = {(r.group_key, r.metric): r for r in inference.calibration_intervals(df, fits, 200).collect()}
    good, tiny = out["all", "calibration_slope"], out["tiny", "calibration_slope"]
    assert good.status == "ok" and good.low < good.estimate < good.high and tiny.status == "too_few_rows" and tiny.low is None


def test_bootstrap_weights_are_shared_by_groups(spark):
    stats = spark.createDataFrame([(m, "g", "k", f"c{c}", 2, float(c), 1.0) for m in ("a", "b") for c in range(5)], "model_name string, grouping_name string, group_key string, cluster string, n long, brier double, log_loss double")
    found = {(r.model_name, r.replicate): r.brier for r in inference.bootstrap_means(stats, 40).collect()}
    assert len(found) == 80 and all(found["a", k] == found["b", k] for k in range(40))


def test_join_checks(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, y double")
    found = {r.check: r.n for r in keys.key_report(left, right, ["k"]).collect()}
    assert found == {"left_rows": 4, "right_rows": 3, "left_repeated_keys": 1, "right_repeated_keys": 0, "left_rows_unmatched": 1, "right_keys_unmatched": 1}
    assert keys.join_checked(left, right, ["k"], complete=False).count() == 4
    for bad in (lambda: keys.join_checked(left, right, ["k"]), lambda: keys.join_checked(left, right, ["k"], "1:1", False), lambda: keys.join_checked(right, left, ["k"], complete=False)):
        with pytest.raises(keys.JoinError):
            bad()
    with pytest.raises(keys.JoinError):
        keys.require_equal(right, right.withColumn("y", F.col("y") + 1), ["k"], ["y"])
    keys.require_equal(right, right, ["k"], ["y"])
    with pytest.raises(keys.JoinError):
        reports.merge_reports(right.withColumnRenamed("y", "z"), left, keys=("k",))
    with pytest.raises(ValueError):
        keys.first_rows(left, [], 3)
    assert keys.first_rows(left, ["k"], None) is left


def test_panels_that_cannot_be_split(spark):
    good = spark.createDataFrame([("r", "c", "1d", dt.datetime(2024, 1, 1), None, "e")], "row_id string, contract_id string, horizon string, forecast_ts timestamp_ntz, event_family_id string, event_id string")
    out, source = folds.checked_panel(good)
    assert source == "event_family_id" and out.first().event_family_id == "e" and folds.checked_panel(good.drop("event_family_id"))[1] == "event_id_fallback"
    for bad in (good.drop("forecast_ts"), good.drop("horizon"), good.drop("event_family_id", "event_id"), good.withColumn("contract_id", F.lit(None).cast("string")), good.drop("event_id")):
        with pytest.raises(folds.SplitError):
            folds.checked_panel(bad)
    empty = folds.make_folds(good.where("false"))
    assert empty.count() == 0 and folds.split_counts(good, empty).count() == 0


def test_validators_raise(spark):
    panel = spark.createDataFrame([(0.5, 1), (1.5, 1), (0.2, None)], "raw_probability double, observed_outcome int")
    with pytest.raises(ValueError, match="1 probabilities and 1 outcomes"):
        metrics.validate_range(panel)
    metrics.validate_range(panel.where("raw_probability = 0.5"))
    with pytest.raises(ValueError, match="missing columns"):
        snapshots.validate(panel)
    with pytest.raises(ValueError):
        edge.fee_entry((), F.lit(1))
    with pytest.raises(ValueError):
        calibration.model_name("none")
    assert calibration.model_name("logistic") == "platt" and calibration.model_name("hierarchical") == "hierarchical_eb"
    with pytest.raises(ValueError):
        inference.cluster_stats(panel, "row_id")
    with pytest.raises(ValueError):
        walkforward.evaluate(panel, None, ("hierarchical_eb",), ("nothing",))


def test_override_clears_every_policy():
    h = (snapshots.Horizon("1d", "1d", "1h", True), snapshots.Horizon("close", "5m", "5m"))
    assert snapshots.override(h) == h
    assert snapshots.override(h, max_staleness="2d") == (snapshots.Horizon("1d", "2d", "6h", False), snapshots.Horizon("close", "2d", "6h", False))
    assert [x.name for x in snapshots.HORIZONS] == ["30d", "14d", "7d", "3d", "1d", "6h", "1h", "15m", "close"]


def test_timestamps():
    assert expr.parse_timestamp(1.7e9) == expr.parse_timestamp(1.7e12) == expr.parse_timestamp("2023-11-14T22:13:20Z")
    for bad in ("2023-11-14T22:13:20", True, dt.datetime(2024, 1, 1)):
        with pytest.raises(ValueError):
            expr.parse_timestamp(bad)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, "c_d")], "id int, name string")
    rows.coalesce(1).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 1, "size": 2}]))
    (tmp_path / "c.jsonl").write_text('\n{"id": 1, "size": 2}\n{"other": 1}\n')
    (tmp_path / "d.tsv").write_text("id\tsize\n1\t2\n")
    (tmp_path / "e.bin").write_bytes(b"x")
    assert readers.sniff_columns(spark, str(tmp_path / "b.json")) == readers.sniff_columns(spark, str(tmp_path / "c.jsonl")) == readers.sniff_columns(spark, str(tmp_path / "d.tsv")) == ["id", "size"]
    with pytest.raises(ValueError):
        readers.sniff_columns(spark, str(tmp_path / "e.bin"))
    found = {r.name: r for r in readers.inspect_files(spark, str(tmp_path), "*.*", (readers.Field("id"), readers.Field("price"))).collect()}
    assert found["e.bin"].columns is None and found["c.jsonl"].missing == ["price"] and len(found["b.json"].sha256) == 64
    groups, bad = readers.schema_groups(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "none.parquet")])
    assert list(groups) == [("id", "name")] and len(bad) == 1
    with pytest.raises(ValueError):
        readers.read_columns_of(spark, str(tmp_path / "a.parquet"), ["id", "price"])
    with pytest.raises(ValueError):
        readers.canonical(rows, readers.TRADE_FIELDS)
    assert "a\\|b" in sinks.to_markdown(rows) and r"c\_d" in sinks.to_latex(rows)
    out = sinks.write_summary(str(tmp_path / "s.json"), {"b": 1, "a": 2}, rows=3)
    assert out["config_sha256"] == sinks.summary({"a": 2, "b": 1})["config_sha256"] and json.loads((tmp_path / "s.json").read_text())["rows"] == 3
    with pytest.raises(ValueError):
        sinks.to_markdown(spark.range(sinks.MAX_REPORT_ROWS + 1))


def test_paired_rows_are_one_to_one(spark):
    schema = "model_name string, grouping_name string, group_key string, row_id string, event_family_id string, brier double, log_loss double"
    rows = lambda model, ids: [(model, "overall", "all", i, f"f{i}", 0.5 if model == "raw" else 0.25, 1.0) for i in ids]
    sound = inference.paired_stats(spark.createDataFrame(rows("raw", "abc") + rows("x", "cab"), schema)).collect()
    assert len(sound) == 3 and all(r.n == 1 and r.brier == -0.25 for r in sound)
    for ids in ("ab", "abcc", "aac", "abd", "abcd", ""):
        with pytest.raises(keys.JoinError):
            inference.paired_stats(spark.createDataFrame(rows("raw", "abc") + rows("x", ids) + rows("y", "abc"), schema)).collect() if ids else inference.paired_stats(spark.createDataFrame(rows("x", "abc"), schema))


def test_binned_statuses(spark):
    df = spark.createDataFrame([("a", 0.05, 1, 40), ("a", 0.55, 0, 3), ("b", 0.05, 1, 40), ("b", 0.95, 0, 30), ("c", 0.5, 1, 4)], "k string, p double, y int, n long")
    found = {r.k: r for r in calibration.fit_binned(df, ["k"], min_rows=20).collect()}
    assert (found["a"].status, found["a"].sparse_bins, found["a"].empty_bins, found["a"].bin_counts[5]) == ("fitted_with_sparse_bins", 1, 8, 3)
    assert (found["b"].status, found["b"].sparse_bins) == ("fitted", 0) and (found["c"].status, found["c"].levels) == ("fallback_too_few_rows", None)


def test_metric_rows_with_fits(spark):
    """Slices, filters and exclusions against plain numpy, with a filter that keeps nothing."""
    rng = random.Random(9)
    raw = [(m, "vwap" if k % 3 else "last_trade", p, int(rng.random() < p), float(k % 50), "sports" if k % 4 == 0 else None, k % 4 == 0) for m in ("raw", "x") for k in range(600) for p in [rng.choice([0.1, 0.25, 0.5, 0.8])]]
    df = spark.createDataFrame([(*r, (r[2] - r[3]) ** 2, 0.0, False, "high") for r in raw], "model_name string, snapshot_method string, predicted_probability double, observed_outcome int, liquidity double, domain string, is_sports boolean, brier double, log_loss double, taxonomy_ambiguous boolean, taxonomy_confidence string")

    def fits(r, mine):
        c, _, _ = plain_newton([x[2] for x in mine], [x[3] for x in mine])
        assert r.row_count == len(mine) and math.isclose(r.intercept, c[0], rel_tol=1e-6, abs_tol=1e-8) and math.isclose(r.slope, c[1], rel_tol=1e-6)

    for r in robustness.method_slices(df, full=True).collect():
        fits(r, [x for x in raw if (x[0], x[1]) == (r.model_name, r.snapshot_method)])
    found = {(r.model_name, r.filter_name): r for r in robustness.liquidity_filters(df, (0.0, 25.0, 1e9), full=True).collect()}
    assert (found["x", "liquidity>=1e+09"].row_count, found["x", "liquidity>=1e+09"].status, found["x", "liquidity>=1e+09"].slope) == (0, "empty_after_filter", None)
    fits(found["raw", "liquidity>=25"], [x for x in raw if x[0] == "raw" and x[4] >= 25])
    out = {(r.model_name, r.filter_name): r for r in robustness.domain_exclusions(df, full=True).collect()}
    fits(out["x", "no_sports"], [x for x in raw if x[0] == "x" and not x[6]])
    assert out["x", "no_ambiguous"].status == "not_applicable"
