"""Walk-forward evaluation: every model is fitted on each fold's past and scored on the same test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import EPSILON, brier, clip, log_loss
from tidemark.operators import calibration as C
from tidemark.operators.folds import assign, fit_counts, fitted_counts, fold_months, month_counts, month_of, tested_counts
from tidemark.session import materialize

KEEP = ["row_id", "contract_id", "event_family_id", "horizon_name", "domain", "forecast_ts", "resolution_ts", "observed_outcome", "raw_probability"]


def evaluate(panel: DataFrame, folds: DataFrame, models: tuple[str, ...] = ("raw", "platt", "beta", "isotonic", "binned_reliability"), context: tuple[str, ...] = ("horizon_name", "domain"), epsilon: float = EPSILON, counted: bool = False) -> DataFrame:
    """fold_id, model_name, the row's columns, predicted_probability, fit_status, fit_row_count. Fits see rows resolved by the test's start only; they are compressed to counts by (fold, price, outcome) once for all models.

    With ``counted`` test rows that have one prediction and outcome under every model are one row, with ``n`` of them and without what tells them apart. Then the panel is scanned once whatever the models: it is enough for the mean scores.
    """
    models = tuple(C.model_name(m) for m in models)
    key = ["fold_id"]
    if missing := [c for c in context if c not in panel.columns and "hierarchical_eb" in models]:
        raise ValueError(f"hierarchical_eb needs {missing}")
    prices = [F.col("raw_probability").alias("p"), F.col("observed_outcome").alias("y")]
    levels = list(context) if "hierarchical_eb" in models else []
    months = materialize(month_counts(panel, [*prices, *levels]), "month-counts")
    data = materialize(fitted_counts(months, folds, ["p", "y"]), "fit-counts")
    if counted:
        keep = ["raw_probability", "observed_outcome", *levels, "n"]
        test = materialize(tested_counts(months, folds, ["p", "y", *levels]).withColumnsRenamed({"p": "raw_probability", "y": "observed_outcome"}), "test-counts")
    else:
        keep = [c for c in KEEP if c in panel.columns]
        test = assign(panel, folds, splits=("test",)).select(*key, *keep)
    out = None
    for model in models:
        if model == "raw":
            rows = test.join(F.broadcast(C.gate(data, key, 0)), key, "left").withColumns({"prediction": clip(F.col("raw_probability"), epsilon), "status": F.lit("not_fitted")})
        elif model in ("platt", "beta"):
            rows = C.predict_logistic(test.join(F.broadcast(C.fit_logistic(data, key, model, epsilon=epsilon)), key, "left"), model, epsilon)
        elif model == "isotonic":
            blocks = materialize(C.fit_isotonic(data, key, epsilon), "isotonic")
            rows = C.predict_isotonic(test.join(C.broadcast_if_small(blocks), key, "left"), epsilon)
        elif model == "binned_reliability":
            rows = C.predict_binned(test.join(F.broadcast(C.fit_binned(data, key, epsilon=epsilon)), key, "left"), epsilon=epsilon)
        else:
            base, offsets = C.fit_hierarchical(materialize(fitted_counts(months, folds, ["p", "y", *levels]), "fit-counts"), key, context, epsilon=epsilon)
            offsets = materialize(offsets, "offsets")
            plain = C.predict_logistic(test.join(F.broadcast(base), key, "left"), "platt", epsilon)
            moved = C._with_offsets(plain, offsets, key, context)
            rows = moved.withColumn("prediction", clip(C.sigmoid(C.logit(clip(F.col("prediction"), epsilon)) + F.col("shift")), epsilon))
        rows = rows.select(*key, F.lit(model).alias("model_name"), *keep, F.col("prediction").alias("predicted_probability"), F.coalesce("status", F.lit("fallback_too_few_rows")).alias("fit_status"), F.coalesce("rows", F.lit(0)).cast("long").alias("fit_row_count"))
        out = rows if out is None else out.unionByName(rows)
    return out


def excluded_future_labels(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold the train and validation rows that a fit may not see, since they were resolved after the test's start: from counts by month."""
    monthly = panel.groupBy(month_of("forecast_ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    rows = monthly.join(F.broadcast(fold_months(folds).where("split <> 'test'")), "month").groupBy("fold_id").agg(F.sum("n").alias("rows"))
    fit = fit_counts(panel, folds, []).withColumnRenamed("n", "fit")
    return rows.join(fit, "fold_id", "left").select("fold_id", "rows", (F.col("rows") - F.coalesce("fit", F.lit(0))).alias("excluded_future_labels"))


def identical_rows(predictions: DataFrame) -> DataFrame:
    """Per fold: test rows, models, and rows that some model lacks or has twice (0 in a sound table)."""
    models = predictions.agg(F.count_distinct("model_name").alias("models"))
    rows = predictions.groupBy("fold_id", "row_id").agg(F.count_distinct("model_name").alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(models)).groupBy("fold_id").agg(F.count(F.lit(1)).alias("rows"), F.max("models").alias("models"), F.count_if((F.col("k") != F.col("models")) | (F.col("n") != F.col("k"))).alias("bad_rows"))


def _fold_sums(predictions: DataFrame) -> DataFrame:
    """fold_id, model_name, row_count, and for each score its sum and the rows that have it. Rows may be counted (column n)."""
    p, y = F.col("predicted_probability"), F.col("observed_outcome")
    n = F.col("n") if "n" in predictions.columns else F.lit(1).cast("long")
    scored = predictions.select("fold_id", "model_name", n.alias("n"), brier(p, y).alias("brier"), log_loss(p, y).alias("log_loss"))
    each = [x for c in ("brier", "log_loss") for x in (F.sum(F.col("n") * F.col(c)).alias(c), F.sum(F.when(F.col(c).isNotNull(), F.col("n"))).alias(f"{c}_rows"))]
    return scored.groupBy("fold_id", "model_name").agg(F.sum("n").alias("row_count"), *each)


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Per fold and model: rows and mean scores."""
    return _fold_sums(predictions).select("fold_id", "model_name", "row_count", *[(F.col(c) / F.col(f"{c}_rows")).alias(f"mean_{c}") for c in ("brier", "log_loss")])


def aggregate_metrics(predictions: DataFrame) -> DataFrame:
    """Per model: pooled over all rows, and the mean of the folds' means, told apart by ``aggregation``; both from one aggregate by fold."""
    scores = ("brier", "log_loss")
    pooled = [(F.sum(c) / F.sum(f"{c}_rows")).alias(f"pooled_{c}") for c in scores]
    macro = [F.avg(F.col(c) / F.col(f"{c}_rows")).alias(f"macro_{c}") for c in scores]
    one = _fold_sums(predictions).groupBy("model_name").agg(F.sum("row_count").alias("row_count"), *pooled, *macro, F.count_distinct("fold_id").alias("folds"))
    kinds = [("pooled", "pooled", F.lit(None).cast("long")), ("fold_macro", "macro", F.col("folds"))]
    rows = [F.struct(*[F.col(f"{name}_{c}").alias(f"mean_{c}") for c in scores], F.lit(kind).alias("aggregation"), n.alias("folds")) for kind, name, n in kinds]
    return one.withColumn("__x", F.explode(F.array(*rows))).select("model_name", "row_count", "__x.*")


def gain_over_time(predictions: DataFrame, baseline: str = "raw") -> DataFrame:
    """Per fold and model the gain in mean Brier score over the baseline."""
    folds = fold_metrics(predictions)
    raw = folds.where(F.col("model_name") == baseline).select("fold_id", F.col("mean_brier").alias("raw_brier"))
    return folds.where(F.col("model_name") != baseline).join(raw, "fold_id").select("fold_id", "model_name", "row_count", (F.col("raw_brier") - F.col("mean_brier")).alias("gain"))
