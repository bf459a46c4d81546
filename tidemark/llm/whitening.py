"""Whitening of embeddings by the covariance of their rounded values.

An entry c becomes the whole number x = floor(64 * c) + 1000000. The fit list is each distinct x vector once, so
copies don't weigh. Its sums S come from one aggregation; a second one sums (x_i - m_i) * (x_j - m_j) for every pair
of dimensions i <= j, as generated SQL expressions, m being the means (at most MAX_SUMS a scan, so that wide vectors
take several). The matrix goes to the driver: its size is the dimension's square, whatever the number of rows. LAPACK
decomposes it there, and every row is projected in Spark.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped. The dimension is the
greatest length found; a shorter vector lacks entries and is dropped as if they were null. An empty table, or one
without a usable row, gives an empty table. Components whose eigenvalue is zero to double precision can't be scaled
to one and are left out (a single distinct vector has none). Repeated rows and ids are projected one by one; a null
id stays null; a deviation beyond 64 bits is null; entries beyond 2^56 count as that; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

COMPONENTS, MAX_SUMS = 16, 4096
STEP, SHIFT = 64, 1_000_000


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """``rows`` with vector_col as doubles, all of one length, without null and non-finite entries."""
    vector = F.col(vector_col).cast("array<double>")
    size = rows.agg(F.max(F.size(vector))).first()[0]
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return rows.withColumn(vector_col, vector).where(F.col(vector_col).isNotNull() & (F.size(vector_col) == F.lit(size or 0)) & (F.size(vector_col) > 0) & good)


def rounded(vector: F.Column) -> F.Column:
    """x = floor(64 * c) + 1000000; what 64 bits can't hold ends at 2^62."""
    most = F.lit(float(1 << 62))
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(F.lit(float(STEP)) * c, -most), most)) + F.lit(SHIFT))


@dataclass(frozen=True)
class Whitener:
    """What a fit leaves: n and S of the fit list, the eigenvalues and eigenvectors kept (rows, by falling eigenvalue), and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]


def covariance(fit: DataFrame, means: list[float], n: int, column: str = "x") -> np.ndarray:
    """The covariance (divisor n) of the array column, each dimension centred before it is multiplied: sums over the upper triangle in one aggregation, or as many as MAX_SUMS asks for."""
    d = len(means)
    centred = fit.selectExpr(*[f"{column}[{i}] - {m!r}D AS c{i}" for i, m in enumerate(means)])
    pairs, out = [(i, j) for i in range(d) for j in range(i, d)], np.zeros((d, d))
    for first in range(0, len(pairs), MAX_SUMS):
        some = pairs[first : first + MAX_SUMS]
        row = centred.selectExpr(*[f"sum(c{i} * c{j})" for i, j in some]).first()
        for (i, j), s in zip(some, row, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """From the distinct vectors (x); None without any."""
    first = fit.select(F.size("x")).first()
    if first is None:
        return None
    sums = fit.selectExpr("count(*)", *[f"sum(CAST(x[{i}] AS DECIMAL(20, 0)))" for i in range(first[0])]).first()
    n, sums = sums[0], [int(s) for s in sums[1:]]
    v = covariance(fit, [s / n for s in sums], n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    rank = int((values > max(values.max(), 0) * len(values) * np.finfo(float).eps).sum())
    kept = order[: min(components, rank)]
    return Whitener(n, sums, values[kept], vectors[:, kept].T, float(np.trace(v)))


def project(column: str, fitted: Whitener) -> F.Column:
    """The whitened components of the array column, as an array."""
    numbers = lambda row: F.array(*[F.lit(float(v)) for v in row])
    weights = F.array(*[numbers(row) for row in fitted.vectors / np.sqrt(fitted.values)[:, None]])
    centred = F.zip_with(column, numbers(fitted.means), lambda v, m: v - m)
    return F.transform(weights, lambda row: F.aggregate(F.zip_with(centred, row, lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    kept = usable(rows.select(id_col, vector_col), vector_col).select(id_col, rounded(F.col(vector_col)).alias("x"))
    fit = materialize(kept.select("x").distinct(), "whitening-fit")
    fitted = fit_whitener(fit, components)
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    k = len(fitted.values)
    again = fit.select(project("x", fitted).alias("w"))
    means = list(again.selectExpr(*[f"avg(w[{i}])" for i in range(k)]).first())
    error = float(np.abs(covariance(again, means, fitted.n, "w") - np.eye(k)).max())
    # Exact in decimals; try_ functions give null where 64 or 38 digits don't hold it.
    sums = "array(" + ", ".join(f"CAST('{s}' AS DECIMAL(38, 0))" for s in fitted.sums) + ")"
    offset = f"try_cast(CAST({fitted.n} AS DECIMAL(18, 0)) * CAST(v AS DECIMAL(19, 0)) - s AS BIGINT)"
    square = "CAST(v AS DECIMAL(19, 0)) * CAST(v AS DECIMAL(19, 0))"
    deviation = f"try_cast(aggregate(zip_with(x, {sums}, (v, s) -> {offset}), CAST(0 AS DECIMAL(38, 0)), (t, v) -> CAST(try_add(t, {square}) AS DECIMAL(38, 0))) AS BIGINT)"
    shares = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values])
    made = kept.select(id_col, F.expr(deviation).alias("deviation"), F.posexplode(project("x", fitted)).alias("at", "whitened"))
    return made.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
