"""Walk-forward folds: expanding months, never random.

Folds start and end with months, so a row's part in every fold follows from two months: that of its forecast, and the
first one by whose start it may be fitted on (after its forecast's month, and not before its resolution). Counts and
fits are made from one aggregate by these months; only :func:`assign` repeats rows, which is its purpose.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOLD_SCHEMA = "fold_id string, train_start timestamp_ntz, val_start timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz"


#: Partitions of contracts for each one of a usual shuffle: a partition's contracts are counted in memory.
SPREAD = 4


def _next(month: dt.datetime, n: int = 1) -> dt.datetime:
    k = month.year * 12 + month.month - 1 + n
    return dt.datetime(k // 12, k % 12 + 1, 1)


def make_folds(panel: DataFrame, months: int = 1, min_train_months: int = 1, ts: str = "forecast_ts") -> DataFrame:
    """A fold per test month: train from the first month to the validation month, validation the month before the test month. The last month goes if it isn't complete; a fold needs rows in all three parts. The driver sees one count per month."""
    months_there = panel.groupBy(month_of(ts).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("t")).where("m IS NOT NULL").collect()
    if not months_there:
        return panel.sparkSession.createDataFrame([], FOLD_SCHEMA)
    counts = {r["m"]: r["n"] for r in months_there}
    start, last = min(counts), max(counts)
    latest = max(r["t"] for r in months_there).replace(tzinfo=None)
    n = lambda a, b: sum(v for m, v in counts.items() if a <= m < b)
    rows, test = [], _next(start, min_train_months + months)
    while test <= last:
        val, end = _next(test, -months), _next(test, months)
        if latest >= end and n(start, val) and n(val, test) and n(test, end):
            rows.append((f"fold_{test:%Y_%m}", start, val, test, end))
        test = _next(test, months)
    return panel.sparkSession.createDataFrame(rows, FOLD_SCHEMA)


def month_of(ts: str | Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def usable_from(ts: str = "forecast_ts", resolved: str = "resolution_ts") -> Column:
    """The first month at whose start a row may be fitted on: null for rows that are never resolved."""
    month, end = month_of(ts), month_of(resolved)
    following = lambda m: F.add_months(m, 1).cast("timestamp_ntz")
    at = F.when(F.col(resolved).isNotNull(), F.when(F.col(resolved) == end, end).otherwise(following(end)))
    return F.when(at.isNotNull(), F.greatest(following(month), at))


def fold_months(folds: DataFrame) -> DataFrame:
    """fold_id, month, split: a row per fold and month of its test, validation and train parts. Folds and months are as many as the calendar has; the table is broadcast."""
    span = F.explode(F.expr("sequence(train_start, test_end - interval 1 month, interval 1 month)")).alias("month")
    split = F.when(F.col("month") < F.col("val_start"), "train").when(F.col("month") < F.col("test_start"), "validation").otherwise("test")
    return folds.select("*", span).select("fold_id", F.col("month").cast("timestamp_ntz").alias("month"), split.alias("split"))


def fit_months(folds: DataFrame) -> DataFrame:
    """fold_id, usable: the values of :func:`usable_from` that a fold may be fitted on."""
    span = F.explode(F.expr("sequence(train_start + interval 1 month, test_start, interval 1 month)"))
    return folds.select("fold_id", span.alias("usable")).select("fold_id", F.col("usable").cast("timestamp_ntz").alias("usable"))


def assign(panel: DataFrame, folds: DataFrame, ts: str = "forecast_ts", splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """fold_id, split (train, validation, test) and the panel's rows, each once per fold it is part of: an equality join on the month."""
    months = fold_months(folds).where(F.col("split").isin(*splits)).join(folds, "fold_id").withColumnRenamed("month", "__month")
    return panel.join(F.broadcast(months), month_of(ts) == F.col("__month")).drop("__month")


def fit_rows(panel: DataFrame, folds: DataFrame, ts: str = "forecast_ts", resolved: str = "resolution_ts") -> DataFrame:
    """Rows to fit a fold on: train and validation rows that were resolved by the test's start."""
    months = fit_months(folds).join(folds, "fold_id").withColumnRenamed("usable", "__usable")
    return panel.join(F.broadcast(months), usable_from(ts, resolved) == F.col("__usable")).where(F.col(ts) >= F.col("train_start")).drop("__usable")


def fit_counts(panel: DataFrame, folds: DataFrame, values: list[Column | str], ts: str = "forecast_ts", resolved: str = "resolution_ts") -> DataFrame:
    """fold_id, ``values``, n: the rows that each fold is fitted on, counted. The panel is reduced once by month and values; folds repeat these counts, not rows."""
    start = folds.agg(F.min("train_start").alias("__start"))
    once = panel.join(F.broadcast(start), F.col(ts) >= F.col("__start")).groupBy(usable_from(ts, resolved).alias("usable"), *values).agg(F.count(F.lit(1)).alias("n"))
    names = [c for c in once.columns if c not in ("usable", "n")]
    return once.join(F.broadcast(fit_months(folds)), "usable").groupBy("fold_id", *names).agg(F.sum("n").alias("n"))


def month_counts(panel: DataFrame, values: list[Column | str], ts: str = "forecast_ts", resolved: str = "resolution_ts") -> DataFrame:
    """usable, month, ``values``, n: the panel reduced by the two months that tell a row's part in every fold, from which :func:`fitted_counts` and :func:`tested_counts` are made without the panel."""
    return panel.groupBy(usable_from(ts, resolved).alias("usable"), month_of(ts).alias("month"), *values).agg(F.count(F.lit(1)).alias("n"))


def fitted_counts(counts: DataFrame, folds: DataFrame, names: list[str]) -> DataFrame:
    """fold_id, ``names``, n: as :func:`fit_counts` has them, from :func:`month_counts`."""
    start = folds.agg(F.min("train_start").alias("__start"))
    once = counts.join(F.broadcast(start), F.col("month") >= F.col("__start")).groupBy("usable", *names).agg(F.sum("n").alias("n"))
    return once.join(F.broadcast(fit_months(folds)), "usable").groupBy("fold_id", *names).agg(F.sum("n").alias("n"))


def tested_counts(counts: DataFrame, folds: DataFrame, names: list[str]) -> DataFrame:
    """fold_id, ``names``, n: the rows that each fold is tested on, counted, from :func:`month_counts`."""
    tests = fold_months(folds).where("split = 'test'").select("fold_id", "month")
    return counts.join(F.broadcast(tests), "month").groupBy("fold_id", *names).agg(F.sum("n").alias("n"))


def split_counts(panel: DataFrame, folds: DataFrame, ts: str = "forecast_ts") -> DataFrame:
    """fold_id, split, n, contracts (distinct), first_ts, last_ts of the assigned rows, from one aggregate by contract and month: a contract is in a train part if its first month is. Rows go to their contract as they are, since contracts have few rows and a table of all that a task has would be no smaller."""
    width = SPREAD * int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = panel.select("contract_id", ts).repartition(width, "contract_id").groupBy("contract_id", month_of(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    each = each.withColumn("new", (F.col("month") == F.min("month").over(Window.partitionBy("contract_id"))).cast("long"))
    monthly = each.groupBy("month").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("new").alias("new"))
    rows = monthly.join(F.broadcast(fold_months(folds)), "month").groupBy("fold_id", "split").agg(F.sum("n").alias("n"), F.sum("new").alias("new"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    later = fold_months(folds).where("split <> 'train'")
    there = each.select("contract_id", "month").join(F.broadcast(later), "month").groupBy("fold_id", "split", "contract_id").agg(F.lit(1).alias("x"))
    there = there.groupBy("fold_id", "split").agg(F.count(F.lit(1)).alias("there"))
    return rows.join(there, ["fold_id", "split"], "left").select("fold_id", "split", "n", F.coalesce("there", "new").alias("contracts"), "first_ts", "last_ts")


def integrity(panel: DataFrame, folds: DataFrame, ts: str = "forecast_ts") -> DataFrame:
    """Per fold: rows of each split, rows in more than one split, and whether the splits follow one another in time. Only row ids that come in several months are assigned row by row."""
    monthly = panel.groupBy(month_of(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    of = lambda s, c: F.when(F.col("split") == s, F.col(c))
    counts = monthly.join(F.broadcast(fold_months(folds)), "month").groupBy("fold_id").agg(
        *[F.coalesce(F.sum(of(s, "n")), F.lit(0)).alias(f"{s}_rows") for s in ("train", "validation", "test")],
        ((F.max(of("train", "last_ts")) < F.min(of("validation", "first_ts"))) & (F.max(of("validation", "last_ts")) < F.min(of("test", "first_ts")))).alias("ordered"),
    )
    torn = panel.groupBy("row_id").agg(F.collect_set(month_of(ts)).alias("months")).where(F.size("months") > 1).select("row_id", F.explode("months").alias("month"))
    torn = torn.join(F.broadcast(fold_months(folds)), "month").groupBy("fold_id", "row_id").agg(F.count_distinct("split").alias("k")).where("k > 1")
    return counts.join(torn.groupBy("fold_id").agg(F.count(F.lit(1)).alias("x")), "fold_id", "left").withColumn("overlapping_rows", F.coalesce("x", F.lit(0))).drop("x")


def leakage(panel: DataFrame, folds: DataFrame, ts: str = "forecast_ts") -> DataFrame:
    """fold_id, event_family_id, splits: families that are in more than one split of a fold. A family's months are reduced first; it is in a train part if its first month is."""
    months = panel.groupBy("event_family_id", month_of(ts).alias("month")).agg(F.lit(1).alias("x"))
    first = months.groupBy("event_family_id").agg(F.min("month").alias("first"))
    later = fold_months(folds).where("split <> 'train'").join(folds.select("fold_id", "val_start"), "fold_id")
    seen = months.join(F.broadcast(later), "month").groupBy("fold_id", "event_family_id").agg(F.collect_set("split").alias("splits"), F.first("val_start").alias("val_start"))
    mine, other = seen.alias("a"), first.alias("b")
    found = mine.join(other, F.col("a.event_family_id").eqNullSafe(F.col("b.event_family_id"))).select("fold_id", "a.event_family_id", F.when(F.col("first") < F.col("val_start"), F.array_union("splits", F.array(F.lit("train")))).otherwise(F.col("splits")).alias("splits"))
    return found.where(F.size("splits") > 1).select("fold_id", "event_family_id", F.array_join(F.sort_array("splits"), ",").alias("splits"))


def family_overlap(panel: DataFrame, folds: DataFrame, ts: str = "forecast_ts") -> DataFrame:
    """fold_id, event_family_id, fit_rows, test_rows: families on both sides of a fold, from counts by family and month."""
    fit = fit_counts(panel, folds, ["event_family_id"], ts).withColumnRenamed("n", "fit_rows")
    test = panel.groupBy("event_family_id", month_of(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    test = test.join(F.broadcast(fold_months(folds).where("split = 'test'")), "month").groupBy("fold_id", "event_family_id").agg(F.sum("n").alias("test_rows"))
    return fit.join(test, ["fold_id", "event_family_id"])


HORIZON_COLUMNS = ("horizon_name", "horizon", "horizon_bucket")


class SplitError(ValueError):
    """A panel that can't be split."""


def normalize_panel(panel: DataFrame, ts: str = "forecast_ts", contract: str = "contract_id", family: str = "event_family_id", fallback: str = "event_id", horizons: tuple[str, ...] = HORIZON_COLUMNS, row_id: str = "row_id") -> tuple[DataFrame, str]:
    """(row_id, contract_id, horizon, forecast_ts, event_family_id and the times that are there; where the family comes from). A null family takes the fallback column. Raises on missing columns and on nulls; row ids are the panel's own."""
    missing = [c for c in (ts, contract, row_id) if c not in panel.columns]
    horizon = next((c for c in horizons if c in panel.columns), None)
    if missing or horizon is None:
        raise SplitError(f"missing columns: {missing or list(horizons)}")
    if family in panel.columns:
        source, value = family, F.coalesce(F.col(family).cast("string"), F.col(fallback).cast("string")) if fallback in panel.columns else F.col(family).cast("string")
    elif fallback in panel.columns:
        source, value = f"{fallback}_fallback", F.col(fallback).cast("string")
    else:
        raise SplitError(f"neither {family} nor {fallback} is there")
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("close_time", "resolution_ts") if c in panel.columns]
    out = panel.select(F.col(row_id).alias("row_id"), F.col(contract).cast("string").alias("contract_id"), F.col(horizon).cast("string").alias("horizon"), F.col(ts).cast("timestamp_ntz").alias("forecast_ts"), value.alias("event_family_id"), *times)
    return out, source


NOT_NULL = ("forecast_ts", "contract_id", "horizon", "event_family_id")


def null_counts(normalized: DataFrame) -> DataFrame:
    """column_name, nulls: of the columns that a split needs."""
    sums = normalized.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in NOT_NULL])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in NOT_NULL])).alias("x")).select("x.*")


def checked_panel(panel: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """:func:`normalize_panel`, raising where a column that a split needs holds nulls."""
    out, source = normalize_panel(panel, **options)
    if bad := {r["column_name"]: r["nulls"] for r in null_counts(out).collect() if r["nulls"]}:
        raise SplitError(f"null values: {bad}")
    return out, source
