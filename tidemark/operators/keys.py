"""Checks of keys, sets and orders: what a join or a report relies on, counted in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import running_sum


class JoinError(ValueError):
    """A join whose sides don't have the keys that were promised."""


def _long(row: DataFrame, names: list[str]) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in names])).alias("x")).select("x.*")


def key_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """check, n: rows of both sides, keys that are repeated on either, left rows without a partner, right keys without one. Null keys equal each other."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).alias("a")
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).alias("b")
    both = a.join(b, same, "full_outer").select(F.col("a.n").alias("l"), F.col("b.n").alias("r"))
    sums = both.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"), F.count_if(F.col("l") > 1).alias("left_repeated_keys"), F.count_if(F.col("r") > 1).alias("right_repeated_keys"),
        F.coalesce(F.sum(F.when(F.col("r").isNull(), F.col("l"))), F.lit(0)).alias("left_rows_unmatched"), F.count_if(F.col("l").isNull()).alias("right_keys_unmatched"),
    )
    return _long(sums, ["left_rows", "right_rows", "left_repeated_keys", "right_repeated_keys", "left_rows_unmatched", "right_keys_unmatched"])


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], relation: str = "m:1", complete: bool = True) -> DataFrame:
    """The left join of ``left`` with ``right``, once the keys are known to be as ``relation`` (m:1, 1:1) says and, if ``complete``, every left row has a partner. Raises :class:`JoinError`."""
    if relation not in ("m:1", "1:1"):
        raise ValueError(relation)
    found = {r["check"]: r["n"] for r in key_report(left, right, keys).collect()}
    bad = ["right_repeated_keys", *(["left_repeated_keys"] if relation == "1:1" else []), *(["left_rows_unmatched"] if complete else [])]
    if wrong := {k: found[k] for k in bad if found[k]}:
        raise JoinError(f"{relation} join on {keys}: {wrong}")
    return left.join(right, keys, "left")


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """column_name, rows, mismatched: joined rows whose sides differ in a column; two nulls are equal."""
    joined = left.select(*keys, *[F.col(c).alias(f"__l_{c}") for c in columns]).join(right.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns]), keys)
    sums = joined.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}"))).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(c).alias("mismatched")) for c in columns])).alias("x")).select("x.*")


def require_equal(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> None:
    """Raises :class:`JoinError` where joined rows differ."""
    if bad := {r["column_name"]: r["mismatched"] for r in mismatches(left, right, keys, columns).collect() if r["mismatched"]}:
        raise JoinError(f"sides differ: {bad}")


def set_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """check, n: distinct keys of the left side only, of the right side only, and of both."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    l, r = F.col("l"), F.col("r")
    sums = each.agg(F.count_if(l > r).alias("left_only"), F.count_if(r > l).alias("right_only"), F.count_if(l == r).alias("both"))
    return _long(sums, ["left_only", "right_only", "both"])


def count_maps(df: DataFrame, columns: list[str], missing: str = "<missing>") -> DataFrame:
    """column_name, value, n: the counts of each column's values, from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).select("x.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def flag_counts(df: DataFrame, flags: list[str]) -> DataFrame:
    """flag, n: how often each boolean holds."""
    sums = df.agg(*[F.count_if(F.col(c)).alias(c) for c in flags])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in flags])).alias("x")).select("x.*")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``position``, its place from 0 in a total order: a running count over sorted ranges."""
    placed = running_sum(df.withColumn("__one", F.lit(1)), [], order, "__one", "__count")
    return placed.select(*df.columns, (F.col("__count") - 1).cast("long").alias("position"))


def first_rows(df: DataFrame, order: list[str | Column], n: int | None) -> DataFrame:
    """The first ``n`` rows in a given order; all rows for None. A limit without an order isn't offered."""
    if n is None:
        return df
    if n < 1 or not order:
        raise ValueError("a limit is positive and has an order")
    return df.orderBy(*order).limit(n)
