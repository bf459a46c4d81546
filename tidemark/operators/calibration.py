"""Calibrators as Spark jobs over all folds at once.

Logistic fits (Platt, beta, the calibration diagnostic) are Newton steps whose gradient and Hessian are one aggregate
per step over the compressed rows (fold, p, y, n); the driver solves a 2 x 2 or 3 x 3 system per fold. Isotonic fits
join the convex minorants of sorted ranges, which gives the same blocks as one pass.
Predictions are expressions over a broadcast table of parameters, one row per fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import EPSILON, bin_index, clip, logit, sigmoid
from tidemark.operators.metrics import by_groupings
from tidemark.session import materialize

RIDGE, TOLERANCE, MAX_ITERATIONS, MIN_ROWS = 1e-9, 1e-8, 100, 20
ALIASES = {"logistic": "platt", "reliability_bin": "binned_reliability", "hierarchical": "hierarchical_eb"}
MODELS = ("raw", "platt", "beta", "isotonic", "binned_reliability", "hierarchical_eb")


def model_name(name: str) -> str:
    found = ALIASES.get(name, name)
    if found not in MODELS:
        raise ValueError(f"unknown model {name!r}")
    return found


def compress(rows: DataFrame, key: list[str], p: str = "raw_probability", y: str = "observed_outcome", context: tuple[str, ...] = ()) -> DataFrame:
    """key, p, y, n: equal rows are counted; all fits are exact on these."""
    return rows.groupBy(*key, F.col(p).alias("p"), F.col(y).alias("y"), *context).agg(F.count(F.lit(1)).alias("n"))


def compress_panel(panel: DataFrame, models: dict[str, Column], groupings: dict[str, list[str]], y: str = "observed_outcome") -> DataFrame:
    """model_name, grouping_name, group_key, p, y, n: what :func:`compress` counts in the panel's rows under each model and grouping. Equal rows are counted before models and groupings repeat them."""
    dims = list(dict.fromkeys(c for cols in groupings.values() for c in cols))
    cells = panel.select(*dims, F.col(y).alias("__y"), *[p.cast("double").alias(f"__p{k}") for k, p in enumerate(models.values())])
    cells = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("__n"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(f"__p{k}").alias("p")) for k, m in enumerate(models)])).alias("__m")
    rows = by_groupings(cells.select(*dims, "__y", "__n", each), groupings)
    return rows.groupBy("__m.model_name", "grouping_name", "group_key", "__m.p", F.col("__y").alias("y")).agg(F.sum("__n").alias("n"))


def gate(data: DataFrame, key: list[str], min_rows: int = MIN_ROWS, epsilon: float = EPSILON) -> DataFrame:
    """key, rows, rate and status: why a fold can't be fitted, or ``ok``."""
    c = clip(F.col("p"), epsilon)
    found = data.groupBy(*key).agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("rate"), F.min("y").alias("y0"), F.max("y").alias("y1"), (F.max(c) - F.min(c)).alias("spread"))
    status = F.when(F.col("rows") < min_rows, "too_few_rows").when(F.col("y0") == F.col("y1"), "outcome_has_no_variation").when(F.col("spread") <= TOLERANCE, "probability_has_no_variation").otherwise("ok")
    return found.select(*key, "rows", "rate", status.alias("status"))


def _features(kind: str, epsilon: float) -> tuple[list[Column], list[float]]:
    c = clip(F.col("p"), epsilon)
    if kind == "beta":
        return [F.lit(1.0), F.log(c), F.log(1 - c)], [0.0, 1.0, -1.0]
    return [F.lit(1.0), logit(c)], [0.0, 1.0]


def fit_logistic(data: DataFrame, key: list[str], kind: str = "platt", min_rows: int = MIN_ROWS, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """key, rows, status, iterations and coefficients (array, null where the fit fell back): Newton steps with a ridge on the diagonal, for all folds together."""
    spark = data.sparkSession
    features, start = _features(kind, epsilon)
    size = len(start)
    data = data.select(*key, "y", "n", *[x.alias(f"x{i}") for i, x in enumerate(features)], "p")
    data = materialize(data, "newton")
    gates = {tuple(r[k] for k in key): r for r in gate(data, key, min_rows, epsilon).collect()}
    state = {k: (np.array(start), 0, "running") for k, r in gates.items() if r["status"] == "ok"}
    schema = ", ".join(f"{data.schema[k].name} {data.schema[k].dataType.simpleString()}" for k in key) + ", c array<double>"
    for step in range(1, max_iterations + 1):
        running = [(*k, [float(v) for v in c]) for k, (c, _, s) in state.items() if s == "running"]
        if not running:
            break
        now = data.join(F.broadcast(spark.createDataFrame(running, schema)), key)
        eta = sum((F.col("c")[i] * F.col(f"x{i}") for i in range(1, size)), F.col("c")[0] * F.col("x0"))
        mu = sigmoid(eta)
        now = now.withColumn("mu", mu).withColumn("w", F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(RIDGE)))
        sums = [F.sum(F.col("n") * (F.col("y") - F.col("mu")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(size)]
        sums += [F.sum(F.col("n") * F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}{j}") for i in range(size) for j in range(i, size)]
        for r in now.groupBy(*key).agg(*sums).collect():  # one row per fold
            k = tuple(r[x] for x in key)
            hessian = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(size)] for i in range(size)]) + RIDGE * np.eye(size)
            try:
                delta = np.linalg.solve(hessian, np.array([r[f"g{i}"] for i in range(size)]))
            except np.linalg.LinAlgError:
                state[k] = (state[k][0], step, "singular_hessian")
                continue
            state[k] = (state[k][0] + delta, step, "converged" if np.abs(delta).max() < TOLERANCE else "running")
    out = []
    for k, r in gates.items():
        c, steps, status = state.get(k, (None, 0, f"fallback_{r['status']}"))
        if status == "running":
            status = "max_iterations"
        if status == "singular_hessian":
            c, status = None, "fallback_singular_hessian"
        if kind == "platt" and c is not None and c[1] < 0:
            c, status = None, "fallback_negative_slope"
        out.append((*k, r["rows"], status, steps, None if c is None else [float(v) for v in c]))
    names = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in key)
    return spark.createDataFrame(out, f"{names}, rows long, status string, iterations int, c array<double>")


def pool(ends: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a monotone fit: neighbours are pooled only where the left mean is strictly above the right."""
    e, t, w = [], [], []
    for end, total, weight in zip(ends, totals, weights, strict=True):
        while t and t[-1] * weight > total * w[-1]:
            total, weight = total + t.pop(), weight + w.pop()
            e.pop()
        e.append(end)
        t.append(total)
        w.append(weight)
    return np.array(e), np.array(t, float), np.array(w, float)


MAX_BROADCAST_BLOCKS = 1 << 20
#: Ranges whose minorants are joined in one task.
FANIN = 64
Blocks = tuple[list[float], list[int], list[float], list[float]]


def _push(blocks: Blocks, end: float, outcome: int, total: float, weight: float) -> bool:
    """Puts a block behind the others and pools while the left mean is strictly above the right; whether any was pooled."""
    e, y, t, w = blocks
    n = len(t)
    while t and t[-1] * weight > total * w[-1]:
        total, weight = total + t.pop(), weight + w.pop()
        e.pop()
        y.pop()
    for x, v in zip(blocks, (end, outcome, total, weight), strict=True):
        x.append(v)
    return len(t) <= n


def join_blocks(left: Blocks, right: Blocks) -> Blocks:
    """Joins the blocks (ends, outcome of the end, totals, weights) of two neighbouring ranges in ``left``: their joint minorant. Only blocks under the common tangent are pooled; from the first block of the right side that stands as it is on, the right side is taken over whole."""
    for k, block in enumerate(zip(*right, strict=True)):
        if not _push(left, *block):
            for x, rest in zip(left, right, strict=True):
                x.extend(rest[k + 1 :])
            break
    return left


def broadcast_if_small(blocks: DataFrame) -> DataFrame:
    """A written table of blocks (levels), for a broadcast if it has MAX_BROADCAST_BLOCKS at most."""
    size = blocks.agg(F.coalesce(F.sum(F.size("levels")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(blocks) if size <= MAX_BROADCAST_BLOCKS else blocks


def fit_isotonic(data: DataFrame, key: list[str], epsilon: float = EPSILON) -> DataFrame:
    """key, rows, status, thresholds, levels. Equal prices aren't pooled: the zeros of a price come before its ones.

    Runs are sorted by key, price and outcome in ranges, however close their prices are. A task keeps the minorant of a key's runs in its range, which is its blocks, batch by batch; the minorants of neighbouring ranges are joined in a tree, and blocks are all that is shuffled.
    """
    kinds = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in key)
    shape = f"{kinds}, part int, at int, p double, t double, w double"
    runs = data.select(*key, clip(F.col("p"), epsilon).cast("double").alias("p"), F.col("y").cast("int").alias("y"), F.col("n").cast("double").alias("n"))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mine, held, kinds = TaskContext.get().partitionId(), None, ([], [], [], []), []

        def result() -> pa.RecordBatch:
            n = len(held[0])
            columns = [*[pa.array([v] * n, kind) for v, kind in zip(mine, kinds, strict=True)], pa.array([part] * n, pa.int32()), pa.array(held[1], pa.int32()), *[pa.array(held[k], pa.float64()) for k in (0, 2, 3)]]
            return pa.RecordBatch.from_arrays(columns, [*key, "part", "at", "p", "t", "w"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in range(len(key))]
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(key))], strict=True))
            p, y, n = (batch.column(len(key) + k).to_numpy() for k in range(3))
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)] if keys else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[a] != mine:
                    if mine is not None:
                        yield result()
                    mine, held = keys[a], ([], [], [], [])
                for end, outcome, weight in zip(p[a:b].tolist(), y[a:b].tolist(), n[a:b].tolist(), strict=True):
                    _push(held, end, outcome, outcome * weight, weight)
        if mine is not None:
            yield result()

    blocks = runs.orderBy(*key, "p", "y").mapInArrow(pooled, shape)
    parts = max(1, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = materialize(blocks, "blocks")

    def merged(pdf: pd.DataFrame) -> Blocks:
        held: Blocks = ([], [], [], [])
        for _, one in pdf.groupby("part", sort=True):
            one = one.sort_values(["p", "at"], kind="stable")
            held = join_blocks(held, tuple(one[c].tolist() for c in ("p", "at", "t", "w")))
        return held

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        e, y, t, w = merged(pdf)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in key}, "part": pdf["part"].iloc[0] // FANIN, "at": np.array(y, np.int32), "p": e, "t": t, "w": w})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        e, _, t, w = merged(pdf)
        levels = np.clip(np.array(t) / np.array(w), epsilon, 1 - epsilon)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in key}, "rows": [int(sum(w))], "status": ["fitted"], "thresholds": [e], "levels": [levels.tolist()]})

    while parts > FANIN:
        blocks = blocks.groupBy(*key, F.floor(F.col("part") / FANIN).alias("__at")).applyInPandas(joined, shape)
        parts = -(-parts // FANIN)
    return blocks.groupBy(*key).applyInPandas(last, f"{kinds}, rows long, status string, thresholds array<double>, levels array<double>")


def fit_binned(data: DataFrame, key: list[str], bins: int = 10, prior: float = 10.0, min_rows: int = MIN_ROWS, epsilon: float = EPSILON, min_bin_count: int = 30) -> DataFrame:
    """key, rows, status, levels, bin_counts, empty_bins, sparse_bins: bin rates drawn to the overall rate by ``prior`` rows, then monotone over the bins. Empty bins have the overall rate; the status tells whether a filled bin has fewer than ``min_bin_count`` rows."""
    kinds = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in key)
    cells = data.groupBy(*key, bin_index(F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0)), bins).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("s"))

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = np.zeros(bins), np.zeros(bins)
        n[pdf["bin"]], s[pdf["bin"]] = pdf["n"], pdf["s"]
        rows, empty, sparse = int(n.sum()), int((n == 0).sum()), int(((n > 0) & (n < min_bin_count)).sum())
        if rows < min_rows:
            out, status = None, "fallback_too_few_rows"
        else:
            rate = np.clip((s + prior * s.sum() / n.sum()) / (n + prior), epsilon, 1 - epsilon)
            e, t, w = pool(np.arange(bins), rate * (n + prior), n + prior)
            out, status = np.clip((t / w)[np.searchsorted(e, np.arange(bins))], epsilon, 1 - epsilon).tolist(), "fitted_with_sparse_bins" if sparse else "fitted"
        counts = n.astype(int).tolist()
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in key}, "rows": [rows], "status": [status], "levels": [out], "bin_counts": [counts], "empty_bins": [empty], "sparse_bins": [sparse]})

    return cells.groupBy(*key).applyInPandas(levels, f"{kinds}, rows long, status string, levels array<double>, bin_counts array<long>, empty_bins int, sparse_bins int")


#: Compressed rows of a key that one task sweeps over; keys with more are swept over by Spark, an aggregate a step.
MAX_STATE = 1 << 20


def fit_hierarchical(data: DataFrame, key: list[str], context: tuple[str, ...], min_level_rows: int = 30, prior: float = 50.0, sweeps: int = 5, epsilon: float = EPSILON, max_state: int = MAX_STATE) -> tuple[DataFrame, DataFrame]:
    """Experimental. Platt, plus shrunken logit offsets of each context level, fitted in turn. Returns (platt parameters, key + column, level, offset); small levels have none. data: compressed with the context columns.

    A key's state is its counts by logit, outcome and levels; the sweeps run inside it where it has at most ``max_state`` rows. Nothing goes through the driver.
    """
    base = fit_logistic(compress_again(data, key), key, "platt", epsilon=epsilon)
    plain = predict_logistic(data.join(F.broadcast(base.select(*key, "c")), key, "left"), "platt", epsilon, p="p")
    levels = [F.col(c).cast("string").alias(c) for c in context]
    state = materialize(plain.groupBy(*key, logit(clip(F.col("prediction"), epsilon)).alias("eta"), F.col("y").cast("double").alias("y"), *levels).agg(F.sum("n").cast("double").alias("n")), "states")
    names = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in key)
    schema = f"{names}, column string, level string, offset double"

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        eta, y, n = (pdf[c].to_numpy(float) for c in ("eta", "y", "n"))
        shift, found = np.zeros(len(pdf)), {}
        coded = {c: pd.factorize(pdf[c]) for c in context}  # a null level is -1
        offsets = {c: np.zeros(len(u)) for c, (_, u) in coded.items()}
        for _ in range(sweeps):
            for c, (codes, names_) in coded.items():
                there = codes >= 0
                mu = 1 / (1 + np.exp(-np.clip(eta + shift, -700, 700)))
                sums = [np.bincount(codes[there], x[there], len(names_)) for x in (n, n * (y - mu), n * mu * (1 - mu))]
                step = np.where(sums[0] >= min_level_rows, sums[0] / (sums[0] + prior) * sums[1] / np.maximum(sums[2], 1e-9), 0.0)
                offsets[c] += step
                shift[there] += step[codes[there]]
                found[c] = sums[0] >= min_level_rows
        rows = [(c, level, offsets[c][k]) for c, (_, names_) in coded.items() for k, level in enumerate(names_) if len(names_) and found[c][k]]
        texts = {k: pd.Series([pdf[k].iloc[0]] * len(rows), dtype=object) for k in key} | {c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("column", "level"))}
        return pd.DataFrame({**texts, "offset": np.array([r[2] for r in rows], float)})

    sizes = state.groupBy(*key).agg(F.count(F.lit(1)).alias("__rows"))
    large = sizes.where(F.col("__rows") > max_state).select(*key)
    offsets = state.join(F.broadcast(sizes.where(F.col("__rows") <= max_state).select(*key)), key).groupBy(*key).applyInPandas(sweep, schema)
    if large.limit(1).count():
        offsets = offsets.unionByName(_swept(materialize(state.join(F.broadcast(large), key), "states"), key, context, min_level_rows, prior, sweeps, schema))
    return base, offsets


def _swept(state: DataFrame, key: list[str], context: tuple[str, ...], min_level_rows: int, prior: float, sweeps: int, schema: str) -> DataFrame:
    """The offsets of keys whose state is too large for a task: an aggregate and a written table of offsets for each step."""
    offsets = state.sparkSession.createDataFrame([], schema)
    for _ in range(sweeps):
        for column in context:
            mu = sigmoid(F.col("eta") + F.col("shift"))
            rows = _with_offsets(state, offsets, key, context).where(F.col(column).isNotNull())
            sums = rows.groupBy(*key, F.col(column).alias("level")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("y") - mu)).alias("g"), F.sum(F.col("n") * mu * (1 - mu)).alias("h"))
            step = F.col("n") / (F.col("n") + prior) * F.col("g") / F.greatest(F.col("h"), F.lit(1e-9))
            steps = sums.where(F.col("n") >= min_level_rows).select(*key, F.lit(column).alias("column"), "level", step.alias("offset"))
            offsets = materialize(offsets.unionByName(steps).groupBy(*key, "column", "level").agg(F.sum("offset").alias("offset")), "offsets")
    return offsets


def compress_again(data: DataFrame, key: list[str]) -> DataFrame:
    return data.groupBy(*key, "p", "y").agg(F.sum("n").alias("n"))


def _with_offsets(rows: DataFrame, offsets: DataFrame, key: list[str], context: tuple[str, ...]) -> DataFrame:
    """rows with shift, the sum of their levels' offsets; levels without one add nothing. The offsets (keys x levels) are written and counted, and broadcast if they are MAX_BROADCAST_BLOCKS at most."""
    shift = F.lit(0.0)
    near = F.broadcast if offsets.count() <= MAX_BROADCAST_BLOCKS else (lambda x: x)
    for column in context:
        mine = offsets.where(F.col("column") == column).select(*key, F.col("level").alias(f"__{column}"), F.col("offset").alias(f"__o_{column}"))
        rows = rows.withColumn(f"__{column}", F.col(column).cast("string")).join(near(mine), [*key, f"__{column}"], "left").drop(f"__{column}")
        shift = shift + F.coalesce(f"__o_{column}", F.lit(0.0))
    return rows.withColumn("shift", shift).drop(*[f"__o_{c}" for c in context])


def predict_logistic(rows: DataFrame, kind: str, epsilon: float = EPSILON, p: str = "raw_probability") -> DataFrame:
    """rows (with c) with prediction; without coefficients it is the clipped probability."""
    x = clip(F.col(p), epsilon)
    c = F.col("c")
    eta = c[0] + c[1] * F.log(x) + c[2] * F.log(1 - x) if kind == "beta" else c[0] + c[1] * logit(x)
    return rows.withColumn("prediction", F.when(c.isNull(), x).otherwise(clip(sigmoid(eta), epsilon)))


def predict_isotonic(rows: DataFrame, epsilon: float = EPSILON, p: str = "raw_probability") -> DataFrame:
    """The level of the first block that ends at or above p; the last block's beyond all."""
    x = clip(F.col(p), epsilon)
    # A binary search: each step halves what lies between lo and hi.
    halve = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    below = lambda a: F.get("thresholds", halve(a)) < x
    step = lambda a, _: F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(below(a), halve(a) + 1).otherwise(a["lo"]).alias("lo"), F.when(below(a), a["hi"]).otherwise(halve(a)).alias("hi")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("thresholds") + 1)).cast("int"))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size("thresholds").alias("hi")), step)["lo"]
    return rows.withColumn("prediction", F.when(F.col("levels").isNull(), x).otherwise(clip(F.col("levels")[F.least(at, F.size("levels") - 1)], epsilon)))


def predict_binned(rows: DataFrame, bins: int = 10, epsilon: float = EPSILON, p: str = "raw_probability") -> DataFrame:
    at = bin_index(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0)), bins)
    return rows.withColumn("prediction", F.when(F.col("levels").isNull(), clip(F.col(p), epsilon)).otherwise(clip(F.col("levels")[at], epsilon)))


def diagnostic(data: DataFrame, key: list[str], min_rows: int = MIN_ROWS, epsilon: float = EPSILON) -> DataFrame:
    """Calibration intercept and slope per group with status and iterations; groups that can't be fitted have neither."""
    found = fit_logistic(data, key, "diagnostic", min_rows, epsilon)
    return found.select(*key, "rows", F.regexp_replace("status", "^fallback_", "").alias("status"), "iterations", F.col("c")[0].alias("intercept"), F.col("c")[1].alias("slope"), (F.col("status") == "converged").alias("converged"))
