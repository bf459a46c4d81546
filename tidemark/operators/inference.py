"""Clustered inference: statistics per event family in Spark, resampling over the families.

Bootstrap weights are Poisson(1), drawn for each (cluster, replicate) from a hash, so that a replicate is a weighted
sum over cluster statistics: blocks of clusters are multiplied by their weights where they are, only the products meet,
and any engine gets the same replicates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import EPSILON, bin_index, clip, logit, sigmoid
from tidemark.operators import calibration
from tidemark.operators.keys import JoinError
from tidemark.operators.metrics import by_groupings, group_key
from tidemark.session import materialize

try:
    # Python's own takes less than half of the time that OpenSSL takes for a short text.
    from _md5 import md5
except ImportError:
    from hashlib import md5

GROUP = ["model_name", "grouping_name", "group_key"]


#: Models up to which each has columns of its own in one aggregate.
MAX_WIDE = 16


def cluster_stats(rows: DataFrame, cluster: str = "event_family_id") -> DataFrame:
    """Per group and cluster: n and the sums of both scores. Models are columns of one aggregate where they are few, which leaves a fraction of the groups."""
    if cluster == "row_id":
        raise ValueError("rows aren't independent: resample clusters")
    models = [r[0] for r in rows.select("model_name").distinct().limit(MAX_WIDE + 1).collect()]
    if not 0 < len(models) <= MAX_WIDE:
        return rows.groupBy(*GROUP, F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("brier").alias("brier"), F.sum("log_loss").alias("log_loss"))
    sums = []
    for k, m in enumerate(models):
        mine = F.col("model_name").eqNullSafe(F.lit(m))
        sums += [F.count_if(mine).alias(f"n{k}"), *[F.sum(F.when(mine, F.col(c))).alias(f"{c}{k}") for c in ("brier", "log_loss")]]
    wide = rows.groupBy("grouping_name", "group_key", F.col(cluster).alias("cluster")).agg(*sums)
    each = [F.struct(F.lit(m).cast("string").alias("model_name"), *[F.col(f"{c}{k}").alias(c) for c in ("n", "brier", "log_loss")]) for k, m in enumerate(models)]
    return wide.withColumn("x", F.explode(F.array(*each))).select("x.model_name", "grouping_name", "group_key", "cluster", "x.n", "x.brier", "x.log_loss").where("n > 0")


#: Rows of a cluster above which it isn't brought together by row.
MAX_CLUSTER_ROWS = 1 << 20


def _large_clusters(narrow: DataFrame) -> Column | None:
    """Whether a row is of a cluster of many rows, of which there are few. narrow: with a text column cluster."""
    counts = narrow.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    large = [r[0] for r in counts.where(F.col("n") > MAX_CLUSTER_ROWS).collect()]  # one for each 2^20 rows at most
    if not large:
        return None
    named = F.coalesce(F.col("cluster").isin([c for c in large if c is not None]), F.lit(False))
    return named | F.col("cluster").isNull() if None in large else named


def _at_cluster(narrow: DataFrame, large: Column | None, summed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``summed``, which repeats rows by grouping and sums them by cluster among others. A row is shuffled once, to its cluster, and repeated there: a cluster has about as many cells as rows, so partial sums would be no fewer than rows. Large clusters are summed where they are."""
    width = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = summed((narrow if large is None else narrow.where(~large)).repartition(width, "cluster"))
    return found if large is None else found.unionByName(summed(narrow.where(large)))


def bin_stats(rows: DataFrame, bins: int = 10, p: str = "predicted_probability", y: str = "observed_outcome", cluster: str = "event_family_id", groupings: dict[str, list[str]] | None = None) -> DataFrame:
    """Per group, cluster and bin: n and the sums of probabilities and outcomes. rows: as by_groupings gives them, or before it with its ``groupings``."""

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*GROUP, "cluster", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"))

    narrow = rows.withColumns({"cluster": F.col(cluster).cast("string"), "bin": bin_index(F.col(p), bins)})
    if groupings is None:
        return summed(narrow)
    narrow = narrow.select("cluster", "bin", *dict.fromkeys(["model_name", p, y, *[c for cols in groupings.values() for c in cols]]))
    return _at_cluster(narrow, _large_clusters(narrow), lambda rows: summed(by_groupings(rows, groupings)))


def kish(stats: DataFrame) -> DataFrame:
    """Clusters and their effective number (sum n)^2 / sum n^2 per group."""
    n = F.sum("n")
    return stats.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("clusters"), n.alias("rows"), (n.cast("double") * n / F.sum(F.col("n") * F.col("n"))).alias("effective_clusters"))


def uniform(cluster: Column, replicate: Column) -> Column:
    """A number in [0, 1) from the md5 of ``cluster|replicate``."""
    h = F.md5(F.concat_ws("|", cluster, replicate.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


#: Poisson(1) is at most k up to POISSON_STEPS[k]; weights end at 7.
POISSON_STEPS = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(7)))


def poisson(u: Column) -> Column:
    """Poisson(1) by inversion, up to 7."""
    out = F.lit(0)
    for step in POISSON_STEPS:
        out = out + F.when(u >= step, 1).otherwise(0)
    return out


REPLICATES = 1000


def draws(clusters: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """cluster, replicate, w: the Poisson weights of each cluster, drawn once for all groups and models. clusters: with a column cluster."""
    each = clusters.select("cluster").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return each.select("cluster", "replicate", poisson(uniform(F.col("cluster"), F.col("replicate"))).cast("int").alias("w"))


#: Replicates of a partial matrix, which bounds a row; clusters whose weights are drawn at a time; partial sums that are added in one task; and bytes of sums that a task holds before it hands them on.
SLAB, CHUNK, FAN_IN, HELD_BYTES = 256, 256, 64, 128 << 20


def _weights(clusters: list[str | None], first: int, last: int) -> np.ndarray:
    """The weights of :func:`draws` for some clusters (rows) in the replicates from ``first`` up to, not with, ``last``."""
    numbers = [str(r).encode() for r in range(first, last)]
    data = []
    for cluster in clusters:
        start = b"" if cluster is None else cluster.encode() + b"|"
        data += [md5(start + number).digest() for number in numbers]
    u = np.frombuffer(b"".join(data), ">u4")[::4] / 4294967296.0
    return np.searchsorted(POISSON_STEPS, u, side="right").reshape(len(clusters), len(numbers)).astype(np.float64)


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, equal where the columns are, and the first row of each number."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        found = c.dictionary_encode(null_encoding="encode")
        # Numbers stay below the rows' count, so they can't overflow.
        codes = np.unique(codes * max(1, len(found.dictionary)) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return codes, np.unique(codes, return_index=True)[1]


def _multiply(keys: int, replicates: int):
    """Rows (cluster, keys, values) sorted by cluster to partial sums by replicate: (keys, slab, part, sums), once for each slab and key, or again when HELD_BYTES were held."""
    slab, chunk, held_bytes = SLAB, CHUNK, HELD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        last, drawn, part = None, None, TaskContext.get().partitionId()

        def result(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            columns = [pa.array(c, schema.field(1 + k).type) for k, c in enumerate(zip(*sums, strict=True))]
            n = len(sums)
            for at, first in enumerate(range(0, replicates, slab)):
                arrays = pa.array([x[:, first : first + slab].ravel() for x in sums.values()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([at] * n, pa.int32()), pa.array([part] * n, pa.int32()), arrays], [*schema.names[1 : 1 + keys], "slab", "part", "sums"])
            sums.clear()

        batch = None
        for batch in batches:
            if not batch.num_rows:
                continue
            clusters = batch.column(0).dictionary_encode(null_encoding="encode")
            index, names = clusters.indices.to_numpy(zero_copy_only=False), clusters.dictionary.to_pylist()
            news = np.r_[0, np.flatnonzero(index[1:] != index[:-1]) + 1]
            ends = np.r_[news[1:], len(index)]
            codes, firsts = _codes(batch.columns[1 : 1 + keys])
            owned = list(zip(*[c.take(pa.array(firsts)).to_pylist() for c in batch.columns[1 : 1 + keys]], strict=True))
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1 + keys :]])
            for at in range(0, len(news), chunk):
                some = [names[index[k]] for k in news[at : at + chunk]]
                # The first cluster's rows may have begun in the batch before.
                drawn = drawn if last is not None and [last] == [(x,) for x in some] else _weights(some, 0, replicates)
                last, width = (some[0],) if len(some) == 1 else None, len(some)
                rows = slice(news[at], ends[at + width - 1])
                owner = np.repeat(np.arange(width), ends[at : at + width] - news[at : at + width])
                mine, place = np.unique(codes[rows], return_inverse=True)
                if len(mine) * width <= 8 * len(owner):  # most keys have most clusters: one product for all
                    dense = np.zeros((len(values), len(mine), width))
                    np.add.at(dense, (slice(None), place, owner), values[:, rows])
                    products = (dense.reshape(-1, width) @ drawn).reshape(len(values), len(mine), replicates)
                else:
                    order = np.argsort(place, kind="stable")
                    cuts = np.searchsorted(place[order], np.arange(len(mine) + 1))
                    products = np.stack([values[:, rows][:, o] @ drawn[owner[o]] for o in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))], 1)
                for k, code in enumerate(mine):
                    name = owned[code]
                    if name in sums:
                        sums[name] += products[:, k]
                    else:
                        sums[name] = products[:, k].copy()
                if len(sums) * len(values) * replicates * 8 > held_bytes:
                    yield from result(batch.schema)
        if sums:
            yield from result(batch.schema)

    return run


def replicate_sums(stats: DataFrame, keys: list[str], values: list[str], replicates: int = REPLICATES) -> DataFrame:
    """keys, replicate, values: the sums of each replicate, weighted by :func:`draws`; every replicate of every key.

    Tasks multiply blocks of clusters by their weights, which they draw in place, and hand on one partial matrix for each key and slab of replicates; these are added in a tree. Each row of the statistics is shuffled once, whatever the replicates; else partial matrices are all that is. stats: with a column cluster.
    """
    rows = stats.select(F.col("cluster").cast("string").alias("cluster"), *keys, *[F.col(v).cast("double").alias(v) for v in values])
    # By number, since asking the plan for its partitions would run it.
    width = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "cluster").sortWithinPartitions("cluster")
    typed = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in keys)
    parts = rows.mapInArrow(_multiply(len(keys), replicates), f"{typed}, slab int, part int, sums array<double>")

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in table.sort_by("part").column("sums").to_pylist()], axis=0)
        one = table.slice(0, 1).drop_columns(["sums", "__at"])
        return one.set_column(one.schema.get_field_index("part"), "part", pa.array([key[-1].as_py()], pa.int32())).append_column("sums", pa.array([total], pa.list_(pa.float64())))

    while True:
        parts = parts.withColumn("__at", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy(*keys, "slab", "__at").applyInArrow(add, f"{typed}, slab int, part int, sums array<double>")
        width = -(-width // FAN_IN)
        if width <= 1:
            break
    # A matrix has the values one after the other, each over the slab's replicates.
    size = F.least(F.lit(SLAB), F.lit(replicates) - F.col("slab") * SLAB)
    each = parts.select(*keys, "slab", "sums", size.alias("size")).select(*keys, "slab", "sums", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"))
    return each.select(*keys, (F.col("slab") * SLAB + F.col("at")).alias("replicate"), *[F.get("sums", F.col("size") * k + F.col("at")).alias(v) for k, v in enumerate(values)])


def bootstrap_means(stats: DataFrame, replicates: int = REPLICATES, metrics: tuple[str, ...] = ("brier", "log_loss")) -> DataFrame:
    """Per group and replicate the weighted ratio of each metric; null where a replicate drew no cluster of the group."""
    found = replicate_sums(stats, GROUP, ["n", *metrics], replicates)
    return found.select(*GROUP, "replicate", *[(F.col(m) / F.nullif(F.col("n"), F.lit(0.0))).alias(m) for m in metrics])


def intervals(means: DataFrame, stats: DataFrame, level: float = 0.95, min_rows: int = 30, min_clusters: int = 5, metrics: tuple[str, ...] = ("brier", "log_loss")) -> DataFrame:
    """Per group and metric: estimate, percentile interval (linear), and a status; groups with too few rows or clusters get no interval."""
    points = stats.groupBy(*GROUP).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"), *[(F.sum(m) / F.sum("n")).alias(f"{m}_estimate") for m in metrics])
    lo, hi = (1 - level) / 2, (1 + level) / 2
    ends = means.groupBy(*GROUP).agg(*[F.percentile(m, F.array(F.lit(lo), F.lit(hi))).alias(f"{m}_ci") for m in metrics])
    status = F.when(F.col("rows") < min_rows, "too_few_rows").when(F.col("clusters") < min_clusters, "too_few_clusters").otherwise("ok")
    wide = points.join(ends, GROUP).withColumn("status", status)
    long = wide.select(*GROUP, "rows", "clusters", "status", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_estimate").alias("estimate"), F.col(f"{m}_ci").alias("ci")) for m in metrics])).alias("x"))
    ok = F.col("status") == "ok"
    return long.select(*GROUP, "rows", "clusters", "status", "x.metric", "x.estimate", F.when(ok, F.col("x.ci")[0]).alias("low"), F.when(ok, F.col("x.ci")[1]).alias("high"))


#: Models whose rows are marked by the bits of a number; row ids that are broadcast; and scores up to which sums of whole parts can't overflow.
MAX_MARKED, MAX_BROADCAST_IDS, MAX_SCORE = 62, 1 << 20, 64.0
#: Units of the two whole numbers that stand for a score in a sum: 2^-20, and 2^-52 for the rest.
COARSE, FINE = 1 << 20, 1 << 32


def _torn_ids(rows: DataFrame, on: list[str], models: list[str], same: list[Column]) -> DataFrame:
    """__id (a hash of ``on``) of rows that don't have each of ``models`` once, with both scores, in range, and with ``same`` alike. Hashes that ids share are among them; a number a row is all that is shuffled."""
    mark = F.coalesce(*[F.when(F.col("model_name") == m, F.lit(1 << k).cast("long")) for k, m in enumerate(models)])
    there = (F.abs("brier") <= MAX_SCORE) & (F.abs("log_loss") <= MAX_SCORE)
    marked = rows.select(F.xxhash64(*on).alias("__id"), F.when(there, mark).alias("mark"), F.xxhash64(*same).alias("same"))
    found = marked.groupBy("__id").agg(F.count(F.lit(1)).alias("n"), F.count("mark").alias("full"), F.bit_or("mark").alias("marks"), F.min("same").alias("a"), F.max("same").alias("b"))
    size = len(models)
    return found.where((F.col("n") != size) | (F.col("full") != size) | (F.col("marks") != (1 << size) - 1) | (F.col("a") != F.col("b"))).select("__id")


def _joined_stats(rows: DataFrame, on: list[str], baseline: str, cluster: str) -> DataFrame:
    """The pairs' differences by a join of rows with those of the baseline; rows meet before they are repeated by grouping. rows: with __g, an array of (grouping_name, group_key)."""
    raw = rows.where(F.col("model_name") == baseline).select(*on, F.col("__g").alias("__h"), F.col("brier").alias("b0"), F.col("log_loss").alias("l0"))
    both = rows.where(F.col("model_name") != baseline).join(raw, on).select("model_name", F.col(cluster).alias("cluster"), F.explode(F.array_intersect("__g", "__h")).alias("__g"), (F.col("brier") - F.col("b0")).alias("b"), (F.col("log_loss") - F.col("l0")).alias("l"))
    both = both.where("__g.grouping_name IS NOT NULL AND __g.group_key IS NOT NULL")
    return both.groupBy("model_name", "__g.grouping_name", "__g.group_key", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("brier"), F.sum("l").alias("log_loss"))


def _summed_stats(rows: DataFrame, models: list[str], baseline: str, cluster: str, groupings: dict[str, list[str]] | None) -> DataFrame:
    """The same for rows that pair one to one, as differences of sums. Scores are added up as whole numbers of 2^-52, so no order of the rows shows in a sum, and equal models differ by exactly zero."""
    number = F.coalesce(*[F.when(F.col("model_name") == m, F.lit(k)) for k, m in enumerate(models)])
    coarse = lambda c: F.floor(F.col(c) * float(COARSE))
    parts = {x: v for c in ("brier", "log_loss") for x, v in ((f"__{c[0]}", coarse(c)), (f"__{c[0]}f", F.floor((F.col(c) * float(COARSE) - coarse(c)) * float(FINE))))}
    rows = rows.withColumns({"__m": number, **parts}).drop("brier", "log_loss")
    if groupings is not None:
        rows = by_groupings(rows, groupings)
    sums = []
    for k in range(len(models)):
        mine = F.col("__m") == k
        sums += [F.count_if(mine).alias(f"n{k}"), *[F.sum(F.when(mine, F.col(x))).alias(f"{x}{k}") for x in parts]]
    wide = rows.where("grouping_name IS NOT NULL AND group_key IS NOT NULL").groupBy("grouping_name", "group_key", F.col(cluster).alias("cluster")).agg(*sums)
    base = models.index(baseline)
    less = lambda x, k: F.col(f"{x}{k}") - F.col(f"{x}{base}")
    score = lambda c, k: (less(f"__{c[0]}", k) + less(f"__{c[0]}f", k) / float(FINE)) / float(COARSE)
    each = [F.struct(F.lit(m).alias("model_name"), F.col(f"n{k}").alias("n"), *[score(c, k).alias(c) for c in ("brier", "log_loss")]) for k, m in enumerate(models) if k != base]
    return wide.withColumn("x", F.explode(F.array(*each))).select("x.model_name", "grouping_name", "group_key", "cluster", "x.n", "x.brier", "x.log_loss").where("n > 0")


def paired_stats(rows: DataFrame, baseline: str = "raw", cluster: str = "event_family_id", one_to_one: bool = True, groupings: dict[str, list[str]] | None = None) -> DataFrame:
    """Per group and cluster: n and the summed score differences of each model to the baseline on the same rows. rows: as by_groupings gives them, or before it with its ``groupings``.

    Where every model has a row once, in the same groups and cluster, the pairs' differences are those of the sums, and no row meets another. Which rows these are not (some model lacks them or has them twice, a score is null, a group differs) is counted first; these alone are joined.

    With ``one_to_one``, raises :class:`tidemark.operators.keys.JoinError` unless every model has each of the baseline's rows once: in each group both sides have as many rows as are paired, and the same sum of their ids' hashes.
    """
    keys = ["grouping_name", "group_key"]
    on = ["row_id"] if groupings is not None else ["row_id", *keys]
    sets = list((groupings or {}).items())
    array = F.array(*[F.struct(F.lit(name).alias(keys[0]), group_key(cols).alias(keys[1])) for name, cols in sets]) if groupings is not None else F.array(F.struct(*keys))
    # Rows without an id or a model pair with none.
    named = rows.where("model_name IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in on))
    models = sorted({r[0] for r in named.select("model_name").distinct().collect()} | {baseline})
    columns = sorted({c for _, cols in sets for c in cols} - {*on, "model_name", cluster, "brier", "log_loss"}) if groupings is not None else keys
    narrow = named.select("model_name", "brier", "log_loss", F.col(cluster), *dict.fromkeys([*on, *columns]))
    if len(models) < 2 or len(models) > MAX_MARKED:
        stats = _joined_stats(narrow.withColumn("__g", array), on, baseline, cluster)
    else:
        torn = materialize(_torn_ids(narrow, on, models, [F.col(cluster), *map(F.col, columns)]), "torn")
        size = torn.count()
        if size:
            near = F.broadcast(torn) if size <= MAX_BROADCAST_IDS else torn
            tagged = narrow.withColumn("__id", F.xxhash64(*on))
            sound, rest = tagged.join(near, "__id", "left_anti"), tagged.join(near, "__id", "left_semi")
            parts = _summed_stats(sound, models, baseline, cluster, groupings).unionByName(_joined_stats(rest.withColumn("__g", array), on, baseline, cluster))
            stats = parts.groupBy(*GROUP, "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "brier", "log_loss")])
        else:
            stats = _summed_stats(narrow, models, baseline, cluster, groupings)
    if not one_to_one:
        return stats
    stats = materialize(stats, "paired")
    grouped = rows if groupings is None else by_groupings(rows, groupings)
    sizes = grouped.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("own"), F.sum(F.xxhash64("row_id").cast("decimal(20,0)")).alias("mark"))
    base = sizes.where(F.col("model_name") == baseline).select("grouping_name", "group_key", F.col("own").alias("theirs"), F.col("mark").alias("their_mark"))
    met = stats.groupBy(*GROUP).agg(F.sum("n").alias("met"))
    # A row a model and group: as many as the report has.
    found = sizes.where(F.col("model_name") != baseline).join(base, ["grouping_name", "group_key"], "full").join(met, GROUP, "left")
    same = (F.col("own") == F.col("theirs")) & (F.col("own") == F.col("met")) & (F.col("mark") == F.col("their_mark"))
    if bad := found.where(~F.coalesce(same, F.lit(False))).first():
        raise JoinError(f"rows of {bad['model_name']} in {bad['grouping_name']} {bad['group_key']} aren't those of {baseline}: {bad['own']} rows, {bad['theirs']} of {baseline}, {bad['met']} pairs")
    return stats


def sign_p_values(means: DataFrame, paired: DataFrame, metrics: tuple[str, ...] = ("brier", "log_loss")) -> DataFrame:
    """Per group and metric: the estimated difference and min(1, 2 * share of replicates on the other side of zero); 1 for a difference of exactly zero."""
    points = paired.groupBy(*GROUP).agg(*[(F.sum(m) / F.sum("n")).alias(f"{m}_estimate") for m in metrics])
    long = means.join(points, GROUP).select(*GROUP, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x"), F.col(f"{m}_estimate").alias("estimate")) for m in metrics])).alias("s")).select(*GROUP, "s.metric", "s.x", "s.estimate")
    other = F.when(F.col("estimate") > 0, F.col("x") <= 0).otherwise(F.col("x") >= 0)
    found = long.groupBy(*GROUP, "metric").agg(F.first("estimate").alias("estimate"), F.avg(other.cast("double")).alias("tail"))
    return found.withColumn("p_value", F.when(F.col("estimate") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("tail")))).drop("tail")


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", order: tuple[str, ...] = (*GROUP, "metric")) -> DataFrame:
    """``tests`` with q_value over all of its rows; a null p counts as 1. The table of tests is as long as models x groups x metrics, not as the data."""
    p_value = F.coalesce(F.col(p), F.lit(1.0))
    ranked = tests.withColumn("rank", F.row_number().over(Window.orderBy(p_value, *order))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    tail = Window.orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("q_value", F.least(F.lit(1.0), F.min(p_value * F.col("m") / F.col("rank")).over(tail))).drop("rank", "m")


def paired_diagnostics(paired: DataFrame) -> DataFrame:
    """Per group: mean of the clusters' mean Brier differences, its standard error and z."""
    x = F.col("brier") / F.col("n")
    found = paired.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("clusters"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    se = F.col("sd") / F.sqrt("clusters")
    return found.select(*GROUP, "clusters", "mean", se.alias("standard_error"), (F.col("mean") / F.nullif(se, F.lit(0.0))).alias("z"))


def bootstrap_ece(cells: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Per group and replicate the calibration error of the weighted clusters, from cluster x bin sums: these are contracted over the clusters for each bin and replicate before the absolute value."""
    by_bin = replicate_sums(cells, [*GROUP, "bin"], ["n", "sp", "sy"], replicates)
    return by_bin.groupBy(*GROUP, "replicate").agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.nullif(F.sum("n"), F.lit(0.0))).alias("ece"))


def paired_ece(cells: DataFrame, replicates: int = REPLICATES, baseline: str = "raw") -> DataFrame:
    """Per group and replicate ece_difference, the model's calibration error less the baseline's under the same draws."""
    each = materialize(bootstrap_ece(cells, replicates), "ece")
    base = each.where(F.col("model_name") == baseline).select("grouping_name", "group_key", "replicate", F.col("ece").alias("base"))
    return each.where(F.col("model_name") != baseline).join(base, ["grouping_name", "group_key", "replicate"]).select(*GROUP, "replicate", (F.col("ece") - F.col("base")).alias("ece_difference"))


def cluster_scores(rows: DataFrame, fits: DataFrame, p: str = "predicted_probability", y: str = "observed_outcome", cluster: str = "event_family_id", epsilon: float = EPSILON) -> DataFrame:
    """Per group and cluster the sums of the calibration fit's scores (s0, s1) and information (h00, h01, h11). fits: intercept and slope per group (see :func:`tidemark.operators.calibration.diagnostic`)."""
    # A row a group, made by the driver: without the broadcast all rows of a group would meet in one task.
    there = F.broadcast(fits.where("slope IS NOT NULL").select(*GROUP, "intercept", "slope"))
    x = logit(clip(F.col(p), epsilon))
    joined = rows.join(there, GROUP).withColumn("__x", x)
    mu = sigmoid(F.col("intercept") + F.col("slope") * F.col("__x"))
    joined = joined.withColumn("__mu", mu).withColumns({"__r": F.col(y) - F.col("__mu"), "__w": F.greatest(F.col("__mu") * (1 - F.col("__mu")), F.lit(1e-12))})
    s = lambda c: F.sum(c)
    x, r, w = F.col("__x"), F.col("__r"), F.col("__w")
    return joined.groupBy(*GROUP, F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), s(r).alias("s0"), s(r * x).alias("s1"), s(w).alias("h00"), s(w * x).alias("h01"), s(w * x * x).alias("h11"))


def _mark(salt: int, name: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(salt), name, key)


def marked_groups(fits: DataFrame, models: dict[str, Column]) -> tuple[DataFrame, int]:
    """A row for each group of ``fits``: its names, the fits of the k-th model as i_k and s_k (null where it has none), and a hash of the names, group, which no two share under the salt that is returned too."""
    mine = lambda m, c: F.max(F.when(F.col("model_name") == m, F.col(c)))
    names = fits.groupBy("grouping_name", "group_key")
    found = materialize(names.agg(*[mine(m, c).alias(f"{c[0]}_{k}") for k, m in enumerate(models) for c in ("intercept", "slope")]), "groups")
    for salt in count():
        marked = found.withColumn("group", _mark(salt, F.col("grouping_name"), F.col("group_key")))
        if marked.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return marked, salt


def panel_scores(panel: DataFrame, groups: DataFrame, salt: int, models: dict[str, Column], groupings: dict[str, list[str]], y: str = "observed_outcome", cluster: str = "event_family_id", epsilon: float = EPSILON) -> DataFrame:
    """Per group and cluster: n, and s0_k and s1_k, the sums of the k-th model's scores, zero where it has no fit. groups, salt: of all of the panel's groups (see :func:`marked_groups`).

    Models are columns and groups numbers, which a row gets before it is shuffled: it is repeated by grouping alone, and no text but the cluster's is met in a repeated row.
    """
    xs = {f"__x{k}": logit(clip(p, epsilon)) for k, p in enumerate(models.values())}
    marks = {f"__g{k}": _mark(salt, F.lit(name), group_key(cols)) for k, (name, cols) in enumerate(groupings.items())}
    narrow = panel.select(F.col(cluster).cast("string").alias("cluster"), F.col(y).alias("__y"), *[x.alias(c) for c, x in (xs | marks).items()])
    slopes = [f"s_{k}" for k in range(len(models))]
    there = F.broadcast(groups.where(F.coalesce(*slopes).isNotNull()).drop("grouping_name", "group_key"))  # a row a group, made by the driver
    residual = lambda k: F.col("__y") - sigmoid(F.col(f"i_{k}") + F.col(f"s_{k}") * F.col(f"__x{k}"))

    def summed(rows: DataFrame) -> DataFrame:
        rows = rows.select("cluster", "__y", *xs, F.explode(F.array(*marks)).alias("group")).join(there, "group").withColumns({f"__r{k}": residual(k) for k in range(len(models))})
        total = lambda x, name: F.coalesce(F.sum(x), F.lit(0.0)).alias(name)
        sums = [x for k in range(len(models)) for x in (total(F.col(f"__r{k}"), f"s0_{k}"), total(F.col(f"__r{k}") * F.col(f"__x{k}"), f"s1_{k}"))]
        return rows.groupBy("group", "cluster").agg(F.count(F.lit(1)).alias("n"), *sums)

    return _at_cluster(narrow, _large_clusters(narrow), summed)


def counted_information(counts: DataFrame, fits: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Per group the sums of the fit's information and scores over all clusters, from the counts that it was made from (see :func:`tidemark.operators.calibration.compress`)."""
    x, w = F.col("__x"), F.col("__w")
    rows = counts.join(F.broadcast(fits.where("slope IS NOT NULL").select(*GROUP, "intercept", "slope")), GROUP).withColumn("__x", logit(clip(F.col("p"), epsilon)))
    rows = rows.withColumn("__mu", sigmoid(F.col("intercept") + F.col("slope") * x))
    rows = rows.withColumns({"__r": F.col("n") * (F.col("y") - F.col("__mu")), "__w": F.col("n") * F.greatest(F.col("__mu") * (1 - F.col("__mu")), F.lit(1e-12))})
    return rows.groupBy(*GROUP).agg(F.sum(w).alias("h00"), F.sum(w * x).alias("h01"), F.sum(w * x * x).alias("h11"), F.coalesce(F.sum("__r"), F.lit(0.0)).alias("t0"), F.coalesce(F.sum(F.col("__r") * x), F.lit(0.0)).alias("t1"))


def _moved(sums: DataFrame, info: DataFrame, fits: DataFrame) -> DataFrame:
    """The fits moved by the inverse information times the weighted scores (s0, s1 by replicate), less their sums."""
    info = info.withColumn("det", F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")).where(F.abs("det") > 1e-12).join(fits.select(*GROUP, "intercept", "slope"), GROUP)
    rows = sums.join(info, GROUP)
    d0, d1 = F.col("s0") - F.col("t0"), F.col("s1") - F.col("t1")
    return rows.select(
        *GROUP, "replicate", (F.col("intercept") + (F.col("h11") * d0 - F.col("h01") * d1) / F.col("det")).alias("calibration_intercept"), (F.col("slope") + (F.col("h00") * d1 - F.col("h01") * d0) / F.col("det")).alias("calibration_slope")
    )


def calibration_replicates(scores: DataFrame, fits: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Per group and replicate intercept and slope by influence functions: the fit moved by the inverse information times the weighted scores. Groups whose information is singular have none."""
    info = scores.groupBy(*GROUP).agg(F.sum("h00").alias("h00"), F.sum("h01").alias("h01"), F.sum("h11").alias("h11"), F.sum("s0").alias("t0"), F.sum("s1").alias("t1"))
    return _moved(replicate_sums(scores, GROUP, ["s0", "s1"], replicates), info, fits)


def _with_intervals(fits: DataFrame, sizes: DataFrame, moved: DataFrame, level: float, min_rows: int, min_clusters: int) -> DataFrame:
    """Per group and metric the fit, its percentile interval and a status. sizes: rows and clusters by group."""
    names = ("calibration_intercept", "calibration_slope")
    lo, hi = (1 - level) / 2, (1 + level) / 2
    ends = moved.groupBy(*GROUP).agg(*[F.percentile(m, F.array(F.lit(lo), F.lit(hi))).alias(f"{m}_ci") for m in names])
    wide = fits.select(*GROUP, F.col("intercept").alias(names[0]), F.col("slope").alias(names[1]), F.col("status").alias("fit_status")).join(sizes, GROUP, "left").join(ends, GROUP, "left")
    status = F.when(F.col(names[1]).isNull(), F.col("fit_status")).when(F.col("rows") < min_rows, "too_few_rows").when(F.col("clusters") < min_clusters, "too_few_clusters").otherwise("ok")
    long = wide.withColumn("status", status).select(*GROUP, "rows", "clusters", "status", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate"), F.col(f"{m}_ci").alias("ci")) for m in names])).alias("x"))
    ok = F.col("status") == "ok"
    return long.select(*GROUP, "rows", "clusters", "status", "x.metric", "x.estimate", F.when(ok, F.col("x.ci")[0]).alias("low"), F.when(ok, F.col("x.ci")[1]).alias("high"))


def calibration_intervals(rows: DataFrame, fits: DataFrame, replicates: int = REPLICATES, level: float = 0.95, min_rows: int = 30, min_clusters: int = 5) -> DataFrame:
    """Per group and metric (calibration_intercept, calibration_slope): the fit, its percentile interval and a status. rows: as by_groupings gives them, under each model."""
    scores = materialize(cluster_scores(rows, fits), "cluster-scores")
    sizes = scores.groupBy(*GROUP).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"))
    return _with_intervals(fits, sizes, calibration_replicates(scores, fits, replicates), level, min_rows, min_clusters)


def panel_intervals(panel: DataFrame, models: dict[str, Column], groupings: dict[str, list[str]], replicates: int = REPLICATES, level: float = 0.95, min_rows: int = 30, min_clusters: int = 5) -> DataFrame:
    """Fits and :func:`calibration_intervals` of a panel under ``models`` (each one's probability for a row), without repeating its rows by model: fits and information come from counts of equal rows, the scores of all models are summed by cluster at once."""
    counts = materialize(calibration.compress_panel(panel, models, groupings), "counts")
    fits = calibration.diagnostic(counts, GROUP)
    groups, salt = marked_groups(fits, models)
    scores = materialize(panel_scores(panel, groups, salt, models, groupings), "cluster-scores")
    sums = replicate_sums(scores, ["group"], [f"s{x}_{k}" for k in range(len(models)) for x in range(2)], replicates)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(f"s0_{k}").alias("s0"), F.col(f"s1_{k}").alias("s1")) for k, m in enumerate(models)]))
    sums = sums.select("group", "replicate", each.alias("__m")).join(F.broadcast(groups.select("group", "grouping_name", "group_key")), "group").select("__m.*", "grouping_name", "group_key", "replicate")
    sizes = scores.groupBy("group").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters")).join(groups, "group")
    # A model that can't be fitted in a group has no rows there.
    sizes = sizes.join(fits.where("slope IS NOT NULL").select(*GROUP), ["grouping_name", "group_key"]).select(*GROUP, "rows", "clusters")
    return _with_intervals(fits, sizes, _moved(sums, counted_information(counts, fits), fits), level, min_rows, min_clusters)
