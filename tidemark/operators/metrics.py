"""Probability scores by groups, weightings and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import EPSILON, bin_index, brier, log_loss

GROUPINGS = {"overall": [], "horizon": ["horizon_name"], "domain": ["domain"], "category": ["category"], "horizon_domain": ["horizon_name", "domain"]}


def scored(panel: DataFrame, p: str = "raw_probability", y: str = "observed_outcome", epsilon: float = EPSILON, bins: int = 10) -> DataFrame:
    """``panel`` with brier, log_loss and bin."""
    return panel.withColumns({"brier": brier(F.col(p), F.col(y)), "log_loss": log_loss(F.col(p), F.col(y), epsilon), "bin": bin_index(F.col(p), bins)})


def group_key(columns: list[str], missing: str = "<missing>") -> Column:
    """The group's values joined by |; ``all`` for the whole panel."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]
    return values[0] if len(values) == 1 else F.concat_ws("|", *values) if values else F.lit("all")


def by_groupings(panel: DataFrame, groupings: dict[str, list[str]] | None = None) -> DataFrame:
    """Each row once per grouping, with grouping_name and group_key: one pass and one shuffle for all groupings, as grouping sets have it. Rows are repeated by a number, and a repeated row makes its own key alone."""
    sets = list((groupings or GROUPINGS).items())
    out = panel.withColumn("__g", F.explode(F.array(*[F.lit(k) for k in range(len(sets))])))
    pick = lambda values: F.coalesce(*[F.when(F.col("__g") == k, v) for k, v in enumerate(values)])
    return out.withColumns({"grouping_name": pick([F.lit(name) for name, _ in sets]), "group_key": pick([group_key(cols) for _, cols in sets])}).drop("__g")


def usable_groupings(panel: DataFrame, groupings: dict[str, list[str]]) -> tuple[dict[str, list[str]], list[str]]:
    """The groupings whose columns are there, and the names of the others."""
    good = {k: v for k, v in groupings.items() if set(v) <= set(panel.columns)}
    return good, sorted(set(groupings) - set(good))


KEYS = ["grouping_name", "group_key"]


def _distinct_counts(rows: DataFrame, groupings: dict[str, list[str]]) -> DataFrame:
    """Per group the distinct contracts and families. A row is shuffled once to its contract, as narrow as it goes, and repeated by grouping there; families are few to a task and are counted where they are."""
    dims = list(dict.fromkeys(c for cols in groupings.values() for c in cols))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = rows.where("contract_id IS NOT NULL").select(*dict.fromkeys(["contract_id", *dims])).repartition(width, "contract_id")
    contracts = by_groupings(pairs, groupings).groupBy(*KEYS, "contract_id").agg(F.lit(1).alias("x")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("contracts"))
    families = by_groupings(rows.select(*dict.fromkeys(["event_family_id", *dims])), groupings).groupBy(*KEYS, "event_family_id").agg(F.lit(1).alias("x")).groupBy(*KEYS).agg(F.count("event_family_id").alias("families"))
    return families.join(contracts, KEYS, "left").withColumn("contracts", F.coalesce("contracts", F.lit(0)))


def equal_contract(rows: DataFrame, groupings: dict[str, list[str]] | None = None) -> DataFrame:
    """The primary aggregation: each row counts the same. rows: as by_groupings(scored(...)) gives them, or before it with its ``groupings``."""
    means = [F.avg("brier").alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss")]
    if groupings is not None:
        dims = list(dict.fromkeys(c for cols in groupings.values() for c in cols))
        found = by_groupings(rows.select(*dict.fromkeys(["brier", "log_loss", *dims])), groupings).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("row_count"), *means)
        return found.join(_distinct_counts(rows, groupings), KEYS).select(*KEYS, "row_count", "contracts", "families", "mean_brier", "mean_log_loss")
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("contract_id").alias("contracts"), F.count_distinct("event_family_id").alias("families"), *means)


def equal_family(rows: DataFrame) -> DataFrame:
    """Means of the event families' means."""
    families = rows.groupBy(*KEYS, "event_family_id").agg(F.count(F.lit(1)).alias("n"), F.avg("brier").alias("b"), F.avg("log_loss").alias("l"))
    return families.groupBy(*KEYS).agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("families"), F.avg("b").alias("mean_brier"), F.avg("l").alias("mean_log_loss"))


def trade_weighted(rows: DataFrame, weight: str = "cumulative_volume") -> DataFrame:
    """Means weighted by volume, over rows with a positive weight."""
    w, total = F.col(weight), F.nullif(F.sum(weight), F.lit(0))
    return rows.where(w > 0).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("row_count"), F.sum(weight).alias("total_weight"), (F.sum(w * F.col("brier")) / total).alias("mean_brier"), (F.sum(w * F.col("log_loss")) / total).alias("mean_log_loss"))


def reliability(rows: DataFrame, bins: int = 10, p: str = "raw_probability", y: str = "observed_outcome", min_count: int = 5, keys: list[str] | None = None) -> DataFrame:
    """One row per group and bin, empty bins included: n, mean_p, mean_y, gap and status (empty, sparse, ok)."""
    keys = keys or KEYS
    found = rows.groupBy(*keys, bin_index(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    every = found.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    named = every.select(*[F.col(k).alias(f"__{k}") for k in [*keys, "bin"]])
    same = [named[f"__{k}"].eqNullSafe(found[k]) for k in [*keys, "bin"]]
    joined = named.join(found, same, "left").select(*[F.col(f"__{k}").alias(k) for k in [*keys, "bin"]], F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y")
    return joined.withColumns({
        "lower": F.col("bin") / F.lit(float(bins)), "upper": (F.col("bin") + 1) / F.lit(float(bins)), "gap": F.abs(F.col("mean_p") - F.col("mean_y")),
        "status": F.when(F.col("n") == 0, "empty").when(F.col("n") < min_count, "sparse").otherwise("ok"),
    })


def ece(rows: DataFrame, bins: int = 10, p: str = "raw_probability", y: str = "observed_outcome", keys: list[str] | None = None) -> DataFrame:
    """Expected calibration error per group: sum over bins of n / N * |mean p - mean y|."""
    keys = keys or KEYS
    cells = rows.groupBy(*keys, bin_index(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return cells.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def metric_table(rows: DataFrame, bins: int = 10, groupings: dict[str, list[str]] | None = None) -> DataFrame:
    """Equal-contract metrics with the calibration error. rows: as for :func:`equal_contract`."""
    if groupings is not None:
        return equal_contract(rows, groupings).join(ece(by_groupings(rows, groupings), bins), KEYS, "left")
    return equal_contract(rows).join(ece(rows, bins), KEYS, "left")


def weighted_ece(rows: DataFrame, weight: Column, bins: int = 10, p: str = "raw_probability", y: str = "observed_outcome", min_count: int = 5, keys: list[str] | None = None) -> DataFrame:
    """ece and sparse_bins under weights; with a positive ``min_count`` empty bins count as sparse as well."""
    keys = keys or KEYS
    cells = rows.withColumn("w", weight).groupBy(*keys, bin_index(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col(p)).alias("wp"), F.sum(F.col("w") * F.col(y)).alias("wy"))
    gap = F.abs(F.col("wp") - F.col("wy"))
    empty = F.lit(bins) - F.count(F.lit(1)) if min_count > 0 else F.lit(0)
    return cells.groupBy(*keys).agg((F.sum(gap) / F.nullif(F.sum("w"), F.lit(0.0))).alias("ece"), (F.count_if(F.col("n") < min_count) + empty).alias("sparse_bins"))


def weighted_metrics(rows: DataFrame, mode: str, bins: int = 10, p: str = "raw_probability", y: str = "observed_outcome", volume: str = "cumulative_volume", keys: list[str] | None = None) -> DataFrame:
    """row_count, total_weight, mean_brier, mean_log_loss, ece, sparse_bins and status under equal_contract, equal_event_family (1 / family size in the group) or trade_weighted (no weight below zero)."""
    keys = keys or KEYS
    if mode == "equal_contract":
        weight = F.lit(1.0)
    elif mode == "equal_event_family":
        weight = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys, "event_family_id"))
    elif mode == "trade_weighted":
        weight = F.greatest(F.coalesce(F.col(volume).cast("double"), F.lit(0.0)), F.lit(0.0))
    else:
        raise ValueError(mode)
    tagged = rows.withColumn("weight", weight)
    total = F.nullif(F.sum("weight"), F.lit(0.0))
    sums = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.sum("weight").alias("total_weight"), (F.sum(F.col("weight") * F.col("brier")) / total).alias("mean_brier"), (F.sum(F.col("weight") * F.col("log_loss")) / total).alias("mean_log_loss"))
    found = sums.join(weighted_ece(tagged, F.col("weight"), bins, p, y, keys=keys), keys, "left")
    return found.withColumns({"weighting": F.lit(mode), "status": F.when(F.col("total_weight") > 0, "ok").otherwise("zero_total_weight")})


def _murphy_cells(rows: DataFrame, bins: int, p: str, y: str, keys: list[str]) -> DataFrame:
    """The filled bins with the group's base rate and rows: a few rows per group, whatever its size."""
    cells = rows.groupBy(*keys, bin_index(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.sum(y).alias("sy"), F.sum(brier(F.col(p), F.col(y))).alias("b"))
    group = Window.partitionBy(*keys)
    return cells.withColumns({"total": F.sum("n").over(group), "base": F.sum("sy").over(group) / F.sum("n").over(group), "my": F.col("sy") / F.col("n")})


def murphy(rows: DataFrame, bins: int = 10, p: str = "predicted_probability", y: str = "observed_outcome", keys: list[str] | None = None, min_count: int = 5, min_rows: int = 30) -> DataFrame:
    """Murphy's decomposition per group: reliability, resolution (both as sums of squares, which don't cancel), uncertainty, what they make, the raw Brier score, the residual of binning, counts of bins, and a status."""
    keys = keys or KEYS
    cells = _murphy_cells(rows, bins, p, y, keys)
    weight = F.col("n") / F.col("total")
    parts = cells.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.first("base").alias("base_rate"), (F.sum("b") / F.sum("n")).alias("raw_brier"),
        F.sum(weight * F.pow(F.col("mp") - F.col("my"), F.lit(2))).alias("reliability"), F.sum(weight * F.pow(F.col("my") - F.col("base"), F.lit(2))).alias("resolution"),
        F.count(F.lit(1)).alias("filled_bins"), (F.lit(bins) - F.count(F.lit(1))).alias("empty_bins"), F.count_if(F.col("n") < min_count).alias("sparse_bins"),
    )
    base = F.col("base_rate")
    made = F.col("reliability") - F.col("resolution") + F.col("uncertainty")
    parts = parts.withColumn("uncertainty", base * (1 - base)).withColumn("decomposed_brier", made)
    return parts.withColumns({"residual": F.col("raw_brier") - F.col("decomposed_brier"), "status": F.when(F.col("row_count") < min_rows, "too_few_rows").otherwise("ok")})


def murphy_bins(rows: DataFrame, bins: int = 10, p: str = "predicted_probability", y: str = "observed_outcome", keys: list[str] | None = None, min_count: int = 5) -> DataFrame:
    """Each bin's part of the decomposition, empty bins included."""
    keys = keys or KEYS
    cells = _murphy_cells(rows, bins, p, y, keys)
    every = cells.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("e")
    c = cells.alias("c")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "bin"]]
    weight = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return every.join(c, same, "left").select(
        *[F.col(f"e.{k}").alias(k) for k in [*keys, "bin"]], (F.col("e.bin") / F.lit(float(bins))).alias("lower"), ((F.col("e.bin") + 1) / F.lit(float(bins))).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), weight.alias("weight"),
        F.col("mp").alias("mean_p"), F.col("my").alias("mean_y"), zero(weight * F.pow(F.col("mp") - F.col("my"), F.lit(2))).alias("reliability"), zero(weight * F.pow(F.col("my") - F.col("base"), F.lit(2))).alias("resolution"),
        F.col("n").isNull().alias("is_empty"), F.coalesce(F.col("n") < min_count, F.lit(False)).alias("is_sparse"),
    )


def edge_bin(p: Column, bins: int) -> Column:
    """The bin by comparing with the edges k / bins, each the start of its bin; the last bin is closed."""
    return sum((F.when(p >= F.lit(k / bins), 1).otherwise(0) for k in range(1, bins)), F.lit(0)).cast("int")


def weighted_bins(rows: DataFrame, weight: Column, keys: list[str], bins: int = 10, p: str = "predicted_probability", y: str = "observed_outcome", min_count: int = 5) -> DataFrame:
    """ece, empty_bins and sparse_bins under weights, with bins by their edges; with a positive ``min_count`` empty bins count as sparse as well. Null where all weights are zero."""
    cells = rows.withColumn("__w", weight).groupBy(*keys, edge_bin(F.col(p), bins).alias("__bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col(p)).alias("wp"), F.sum(F.col("__w") * F.col(y)).alias("wy")
    )
    empty = F.lit(bins) - F.count(F.lit(1))
    return cells.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("wp") - F.col("wy"))) / F.nullif(F.sum("w"), F.lit(0.0))).alias("ece"), empty.alias("empty_bins"), (F.count_if(F.col("n") < min_count) + (empty if min_count > 0 else F.lit(0))).alias("sparse_bins")
    )


def metric_rows(rows: DataFrame, keys: list[str], bins: int = 10, p: str = "predicted_probability", y: str = "observed_outcome", min_count: int = 5) -> DataFrame:
    """Per group: row_count, mean_brier, mean_log_loss, ece, empty_bins, sparse_bins, from one aggregate by bin. rows: with brier and log_loss."""
    cells = rows.groupBy(*keys, bin_index(F.col(p), bins).alias("__bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("brier").alias("b"), F.sum("log_loss").alias("l"), F.abs(F.sum(p) - F.sum(y)).alias("gap")
    )
    n = F.sum("n")
    return cells.groupBy(*keys).agg(
        n.alias("row_count"), (F.sum("b") / n).alias("mean_brier"), (F.sum("l") / n).alias("mean_log_loss"), (F.sum("gap") / n).alias("ece"),
        (F.lit(bins) - F.count(F.lit(1))).alias("empty_bins"), F.count_if(F.col("n") < min_count).alias("sparse_bins"),
    )


def full_rows(rows: DataFrame, keys: list[str], **options) -> DataFrame:
    """:func:`metric_rows` with the calibration intercept, slope and their status."""
    from tidemark.operators import calibration

    fits = calibration.diagnostic(calibration.compress(rows, keys, p=options.get("p", "predicted_probability")), keys)
    fits = fits.select(*[F.col(k).alias(f"__{k}") for k in keys], "intercept", "slope", F.col("status").alias("calibration_status"))
    found = metric_rows(rows, keys, **options)
    return found.join(fits, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def by_grouping_sets(rows: DataFrame, groupings: dict[str, list[str]] | None = None) -> DataFrame:
    """grouping_name, each dimension as a column of its own type (null where the grouping doesn't have it), row_count, mean_brier, mean_log_loss. A null value of a dimension stays apart from a missing dimension by the grouping's name."""
    groupings = groupings or GROUPINGS
    dims = sorted({c for cols in groupings.values() for c in cols})
    number = {sum(1 << (len(dims) - 1 - k) for k, c in enumerate(dims) if c not in cols): name for name, cols in groupings.items()}
    found = rows.groupingSets([[F.col(c) for c in cols] for cols in groupings.values()], *[F.col(c) for c in dims]).agg(
        F.grouping_id().alias("__id"), F.count(F.lit(1)).alias("row_count"), F.avg("brier").alias("mean_brier"), F.avg("log_loss").alias("mean_log_loss")
    )
    name = F.element_at(F.create_map(*[F.lit(x) for i, n in number.items() for x in (i, n)]), F.col("__id").cast("int"))
    return found.select(name.alias("grouping_name"), *dims, "row_count", "mean_brier", "mean_log_loss")


def skipped_groupings(panel: DataFrame, groupings: dict[str, list[str]]) -> DataFrame:
    """grouping_name, missing: the groupings that the panel's columns don't allow, and the columns that lack."""
    _, names = usable_groupings(panel, groupings)
    rows = [(n, ",".join(c for c in groupings[n] if c not in panel.columns)) for n in names]
    return panel.sparkSession.createDataFrame(rows, "grouping_name string, missing string")


def range_report(panel: DataFrame, p: str = "raw_probability", y: str = "observed_outcome") -> DataFrame:
    """One row: bad_probabilities (null or out of 0 to 1), bad_outcomes (anything but 0 and 1)."""
    return panel.agg(F.count_if(F.col(p).isNull() | ~F.col(p).between(0, 1)).alias("bad_probabilities"), F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1)).alias("bad_outcomes"))


def validate_range(panel: DataFrame, p: str = "raw_probability", y: str = "observed_outcome") -> None:
    """Raises unless all probabilities are within 0 and 1 and all outcomes are 0 or 1."""
    found = range_report(panel, p, y).first()
    if found["bad_probabilities"] or found["bad_outcomes"]:
        raise ValueError(f"{found['bad_probabilities']} probabilities and {found['bad_outcomes']} outcomes are out of range")
