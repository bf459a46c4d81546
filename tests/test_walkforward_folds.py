"""The hierarchical model is evaluated on every fold."""

from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import walkforward

SF = "/root/testdata/sf0.001"


def test_hierarchical_on_all_folds(spark):
    want = {(r.fold_id, r.row_count) for r in catalog.queries()["d14_walkforward_fold_metrics"](spark, SF).where("model_name = 'raw'").collect()}
    got = catalog.queries()["m8_hierarchical"](spark, SF).collect()
    assert len(want) > 3
    for model in ("raw", "hierarchical_eb"):
        assert {(r.fold_id, r.row_count) for r in got if r.model_name == model} == want


def test_all_models_hold_the_hierarchical_one(spark):
    rows = {(r.model_name, r.aggregation): r for r in catalog.queries()["d14_walkforward_all_models"](spark, SF).collect()}
    for kind in ("pooled", "fold_macro"):
        raw, found = rows["raw", kind], rows["hierarchical_eb", kind]
        assert (found.row_count, found.folds) == (raw.row_count, raw.folds)


def test_counted_rows_give_the_same_means(spark):
    """Test rows that are alike are one row for every model, and the panel is read once for the counts and not again for each model."""
    panel, made = catalog._folded(spark, SF)
    models = ("raw", "platt", "beta", "isotonic", "binned_reliability", "hierarchical_eb")
    plain, counted = (walkforward.evaluate(panel, made, models, counted=c) for c in (False, True))
    assert not any("lineitem" in f for f in counted.inputFiles())
    assert counted.count() < plain.count() == counted.agg(F.sum("n")).first()[0]
    for metrics in (walkforward.fold_metrics, walkforward.aggregate_metrics):
        a, b = ({(r.model_name, r[k]): r for r in metrics(x).collect() for k in ("fold_id", "aggregation") if k in r} for x in (plain, counted))
        assert a.keys() == b.keys() and len(a) >= 12
        for k, want in a.items():
            assert b[k].row_count == want.row_count and abs(b[k].mean_brier - want.mean_brier) < 1e-12 and abs(b[k].mean_log_loss - want.mean_log_loss) < 1e-12


def test_rows_without_a_score_are_counted(spark):
    rows = spark.createDataFrame([("f", "raw", 0.5, 1, 3), ("f", "raw", None, 1, 2), ("f", "raw", 0.1, 0, 1), ("g", "raw", None, 0, 1)], "fold_id string, model_name string, predicted_probability double, observed_outcome int, n long")
    got = {r.fold_id: r for r in walkforward.fold_metrics(rows).collect()}
    assert (got["f"].row_count, got["g"].row_count, got["g"].mean_brier) == (6, 1, None) and abs(got["f"].mean_brier - 0.19) < 1e-12
