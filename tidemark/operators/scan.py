"""Running values over a total order, as an associative scan over sorted ranges.

Rows are sorted by ranges of the whole order, whatever stands alike at its start. A task scans its range and keeps the
running values of each key, Arrow batch by batch; one summary a range and key is carried over to the ranges behind it.
So no key, time or id prefix meets in one task, and only summaries meet in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize

#: Summaries that all executors get; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1 << 16


def _changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where a row's keys differ from those of the row before it; nulls are alike."""
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.equal(pc.is_null(a), pc.is_null(b)), pc.equal(a, b))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def scan_ranges(df: DataFrame, keys: list[str], order: list[str | Column], step: Callable[[], Callable], schema: str, tag: str) -> DataFrame:
    """``df`` sorted by keys and order in ranges, with __part (the range's number) and what a range's scan adds (``schema``), written. step() gives a function (batch, starts, same_key) -> arrays, called in the range's order: starts are the rows that begin a key's run, without the batch's first row, and same_key tells whether that one goes on with the key of the batch before."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, scan = TaskContext.get().partitionId(), None, step()
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(names.index(k)) for k in keys]
            ends = [c[0].as_py() for c in columns], [c[-1].as_py() for c in columns]
            added = scan(batch, np.flatnonzero(_changes(columns, len(batch))), last is not None and ends[0] == last)
            last = ends[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), *added], names=[*names, "__part", *[x.split(" ")[0] for x in schema.split(", ")]])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return materialize(df.orderBy(*keys, *order).mapInArrow(run, f"{typed}, __part int, {schema}"), tag)


def with_carried(scanned: DataFrame, keys: list[str], summary: Column, merge: Callable[[Column], Column], carried: str) -> DataFrame:
    """``scanned`` with ``carried``: the ``summary`` (an aggregate of a range and key) of the key's earlier ranges, merged by an aggregate over a window; null in a key's first range."""
    sums = scanned.groupBy(*keys, "__part").agg(summary.alias("__s"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__at"), merge(F.col("__s")).over(earlier).alias(carried)).where(F.col(carried).isNotNull())
    starts = materialize(starts, "carried")
    near = F.broadcast(starts) if starts.count() <= MAX_BROADCAST_ROWS else starts
    on = [F.col("__part") == F.col("__at"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    return scanned.join(near, on, "left").drop("__at", *[f"__k{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` (a null counts as 0) over the key's rows up to each row in a total order."""
    at = df.columns.index(value)

    def step() -> Callable:
        total = 0.0

        def scan(batch: pa.RecordBatch, starts: np.ndarray, goes_on: bool) -> list[pa.Array]:
            nonlocal total
            x = pc.fill_null(pc.cast(batch.column(at), pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            bounds = [0, *starts.tolist(), len(x)]
            parts = [np.cumsum(x[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            if goes_on:
                parts[0] = parts[0] + total
            total = float(parts[-1][-1])
            return [pa.array(np.concatenate(parts))]

        return scan

    scanned = scan_ranges(df, keys, order, step, "__run double", "running")
    found = with_carried(scanned, keys, F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))), F.sum, "__before")
    return found.select(*df.columns, (F.coalesce("__before", F.lit(0.0)) + F.col("__run")).alias(out))


def running_last(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the last ``value`` that isn't null among the key's rows up to each row in a total order."""
    at = df.columns.index(value)

    def step() -> Callable:
        held = None

        def scan(batch: pa.RecordBatch, starts: np.ndarray, goes_on: bool) -> list[pa.Array]:
            nonlocal held
            column = batch.column(at)
            n = len(column)
            # What was held stands before the batch as row 0.
            pool = pa.concat_arrays([held if goes_on and held is not None else pa.nulls(1, column.type), column])
            there = pool.is_valid().to_numpy(zero_copy_only=False)
            places = np.where(there, np.arange(n + 1), -1)
            bounds = [0, *(starts + 1).tolist(), n + 1]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                np.maximum.accumulate(places[a:b], out=places[a:b])
            found = pool.take(pa.array(places[1:], pa.int64(), mask=places[1:] < 0))
            held = found.slice(n - 1)
            return [found]

        return scan

    kind = df.schema[value].dataType.simpleString()
    scanned = scan_ranges(df, keys, order, step, f"__run {kind}", "running")
    # A key's last value in a range stands in its last row there, the largest run of the scan.
    last = F.max_by(F.col("__run"), F.when(F.col("__run").isNotNull(), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])))
    found = with_carried(scanned, keys, last, lambda s: F.last(s, ignorenulls=True), "__before")
    return found.select(*df.columns, F.coalesce("__run", "__before").alias(out))
