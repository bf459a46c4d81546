"""Exact percentiles of large groups in bounded memory, by selection on counts.

One scan counts a group's values in cells, which follow the values' order (a fixed number of cells an octave and sign).
The counts tell which cell holds a rank. A second scan counts the distinct values of those cells alone; a cell of more
than MAX_CELL rows is cut into CUTS equal parts first, and the part that holds the rank again, as often as it takes. So
no task gets more than MAX_CELL values of a group, and other sums can be made in the first scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import discard, materialize

MAX_BROADCAST_ROWS = 1 << 16
#: Cells an octave; below 1 / ONE_UNIT cells have equal widths. Rows of a cell that are counted by value; and parts that a larger one is cut into.
OCTAVE, ONE_UNIT, MAX_CELL, CUTS = 64, 1 << 20, 1 << 20, 4096
_CELL = ["__cell", "__c", "__lo", "__hi"]


def cell_of(x: Column) -> Column:
    """A number that never falls where x rises; infinite values and NaN, the largest of all, have cells of their own."""
    size = F.floor(F.log2(1 + F.abs(x) * ONE_UNIT) * OCTAVE).cast("int")
    end = F.lit(1 << 20)
    return F.when(F.isnan(x), end + 1).when(F.abs(x) == float("inf"), F.when(x > 0, end).otherwise(-end)).when(x < 0, -1 - size).otherwise(size)


def cells(df: DataFrame, keys: list[str], value: str, *sums: Column, weight: str | None = None) -> DataFrame:
    """keys, __cell, __c (values that aren't null; with ``weight`` a row stands for so many), __lo, __hi and ``sums`` by group and cell: the first scan."""
    x = F.col(value).cast("double")
    count = F.coalesce(F.sum(F.when(x.isNotNull(), F.col(weight))), F.lit(0)) if weight else F.count(x)
    return df.groupBy(*keys, cell_of(x).alias("__cell")).agg(count.alias("__c"), F.min(x).alias("__lo"), F.max(x).alias("__hi"), *sums)


def _holding(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """counts with __from, the values before a row of its group ``by`` in ``order``."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__from", F.coalesce(F.sum("__c").over(before), F.lit(0)))


def percentiles_of(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...], found: DataFrame, weight: str | None = None) -> DataFrame:
    """keys, point, value: percentiles with linear interpolation, as ``percentile`` gives them; nulls don't count. found: :func:`cells` of the same rows, written, with the same ``weight``."""
    own = [f"__k{i}" for i in range(len(keys))]
    counts = found.where("__c > 0").select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *_CELL)
    total = counts.groupBy(*own).agg(F.sum("__c").alias("__n"))
    asked = total.withColumn("point", F.explode(F.array(*map(F.lit, points)))).withColumn("__at", F.col("point") * (F.col("__n") - 1))
    ranks = asked.select(*own, "point", "__at", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__rank"))
    same = lambda a, b: [F.col(f"a.{o}").eqNullSafe(F.col(f"b.{o}")) for o in (*a, *b)]

    def narrowed(targets: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
        """Each rank with the part that holds it; __rank counts from the part's first value."""
        a, b = targets.alias("a"), _holding(parts, by, "__lo").alias("b")
        inside = (F.col("a.__rank") >= F.col("b.__from")) & (F.col("a.__rank") < F.col("b.__from") + F.col("b.__c"))
        met = a.join(b, [*same(own, [x for x in by if x not in own]), inside])
        return met.select(*[F.col(f"a.{o}") for o in own], "a.point", "a.__at", F.coalesce("a.__first", F.col("a.__rank")).alias("__first"), (F.col("a.__rank") - F.col("b.__from")).alias("__rank"), "b.__lo", "b.__hi", "b.__c")

    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("__x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w")).where("__x IS NOT NULL AND __w > 0")
    targets, made = materialize(narrowed(ranks.withColumn("__first", F.lit(None).cast("long")), counts, own), "ranks"), []
    while True:
        made.append(targets)
        size, open_cells = targets.where("__lo < __hi").agg(F.coalesce(F.max("__c"), F.lit(0)), F.count(F.lit(1))).first()
        if not open_cells:
            break
        some = targets.where("__lo < __hi").select(*own, F.col("__lo").alias("__low"), F.col("__hi").alias("__high")).distinct()
        near = F.broadcast(some) if open_cells <= MAX_BROADCAST_ROWS else some
        met = rows.alias("a").join(near.alias("b"), [*same(own, []), F.col("a.__x").between(F.col("b.__low"), F.col("b.__high"))])
        # A place in a cell is never lower for a larger value; each value is a part of its own once the cell is small.
        place = F.floor((F.col("__x") - F.col("__low")) / (F.col("__high") - F.col("__low")) * CUTS) if size > MAX_CELL else F.col("__x")
        parts = met.select(*[F.col(f"a.{o}") for o in own], "__low", place.alias("__place"), "__x", "__w").groupBy(*own, "__low", "__place").agg(F.sum("__w").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        done = targets.where("__lo = __hi")
        open_ = targets.where("__lo < __hi").withColumnRenamed("__lo", "__low")
        targets = materialize(done.unionByName(narrowed(open_, parts, [*own, "__low"])), "ranks")
    down, up = F.col("__first") == F.floor("__at"), F.col("__first") == F.ceil("__at")
    ends = targets.groupBy(*own, "point", "__at").agg(F.max(F.when(down, F.col("__lo"))).alias("a"), F.max(F.when(up, F.col("__lo"))).alias("b"))
    between = F.col("a") + (F.col("__at") - F.floor("__at")) * (F.col("b") - F.col("a"))
    for table in made[:-1]:
        discard(table)
    return ends.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "point", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("value"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """keys, point, value: :func:`percentiles_of` a frame."""
    return percentiles_of(df, keys, value, points, materialize(cells(df, keys, value), "cells"))


def with_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], *sums: Column, weight: str | None = None) -> DataFrame:
    """keys, ``sums`` over each group, and a column for each point (name: point). The sums (each an aliased F.sum, F.count or F.count_if) and the first counts are made in one scan. With ``weight``, a column of counts, a row's value counts so often; ``sums`` are as they are given."""
    found = materialize(cells(df, keys, value, *sums, weight=weight), "cells")
    names = [c for c in found.columns if c not in (*keys, *_CELL)]
    whole = found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names], F.sum("__c").alias("__values"))
    each = percentiles_of(df, keys, value, tuple(sorted(set(points.values()))), found, weight)
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    wide = each.groupBy(*own).agg(*[F.max(F.when(F.col("point") == p, F.col("value"))).alias(name) for name, p in points.items()])
    joined = whole.join(wide, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left")
    return joined.drop(*[f"__k{i}" for i in range(len(keys))], "__values")
