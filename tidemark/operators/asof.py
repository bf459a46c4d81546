"""Point-in-time windows over trades from mergeable states of contract days.

A window ends at a row's forecast and is closed at both ends. Whole days inside it come from a tree of dyadic day
ranges, counted from the contract's first day with a trade: O(log days) nodes a window, each met by an equality join on
(contract, level, index), to which a node has one row. Only the days in which a window begins or ends meet their trades,
by an equality join on (contract, day). So no task needs more than a contract's day of trades at a time, and a row
never meets its contract's history. The last trade up to a forecast is that of the history's states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expr import plus_seconds

KEYS = ["contract_id", "horizon"]
#: The window that has no beginning.
HISTORY = "history"
STATE = ["n", "volume", "money", "moments", "first", "last"]


def day_number(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def _trade_states() -> list[Column]:
    """The state of trades: n, sums of volume and of price times volume, moments (count, mean, sum of squared deviations of the price), first and last trade by (source_ts, trade_id)."""
    k = F.count("price")
    return [
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("money"),
        F.struct(k.alias("k"), F.coalesce(F.avg("price"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("price") * k, F.lit(0.0)).alias("m2")).alias("moments"),
        F.min(F.struct("source_ts", "trade_id", "price")).alias("first"), F.max(F.struct("source_ts", "trade_id", "price", "cents", "volume")).alias("last"),
    ]


def _merged_states() -> list[Column]:
    """Aggregates that merge states. The moments of a group are as few as its days or nodes, and are merged pair by pair."""
    start = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        k = a["k"] + b["k"]
        share, delta = b["k"] / F.greatest(k, F.lit(1)), b["mean"] - a["mean"]
        return F.struct(k.alias("k"), (a["mean"] + delta * share).alias("mean"), (a["m2"] + b["m2"] + delta * delta * a["k"] * share).alias("m2"))

    return [
        F.sum("n").alias("n"), F.sum("volume").alias("volume"), F.sum("money").alias("money"),
        F.aggregate(F.collect_list("moments"), start, merge).alias("moments"), F.min("first").alias("first"), F.max("last").alias("last"),
    ]


def day_states(prices: DataFrame) -> DataFrame:
    """contract_id, day, state; and the contract's first and last day with a trade. Partial sums are all that is shuffled of a contract."""
    days = prices.withColumn("day", day_number(F.col("source_ts"))).groupBy("contract_id", "day").agg(*_trade_states())
    own = Window.partitionBy("contract_id")
    return days.withColumns({"from": F.min("day").over(own), "to": F.max("day").over(own)})


def day_tree(days: DataFrame) -> DataFrame:
    """contract_id, level, index, state: the ranges of 2^level days from index * 2^level on, up to the level that holds all of a contract's days."""
    top = F.ceil(F.log2((F.col("to") - F.col("from") + 1).cast("double"))).cast("int")
    levels = days.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    index = F.floor((F.col("day") - F.col("from")) / F.pow(F.lit(2.0), F.col("level"))).cast("int")
    return levels.groupBy("contract_id", "level", index.alias("index")).agg(*_merged_states())


def _nodes(begin: Column, end: Column, levels: Column) -> Column:
    """The tree's nodes that make up the days from ``begin`` up to, not with, ``end``, as an array of (level, index)."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        a, b = F.ceil(begin / size).cast("int"), F.floor(end / size).cast("int")
        node = lambda inside, index: F.when((a < b) & inside, F.struct(level.alias("level"), index.alias("index")))
        return F.array(node(a % 2 == 1, a), node(b % 2 == 1, b - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), levels), at)))


def window_states(rows: DataFrame, prices: DataFrame, windows: dict[str, int | Column]) -> DataFrame:
    """contract_id, horizon, and for each window (name: its length in seconds, which may be a column of ``rows``) a struct of STATE over the trades from forecast_ts less the length up to forecast_ts; and the struct ``history`` over all up to it. Rows without any trade up to their forecast are left out; a window without a trade is null.

    rows: contract_id, horizon, forecast_ts. prices: contract_id, trade_id, source_ts, price, cents, volume.
    """
    if "cents" not in prices.columns:
        prices = prices.withColumn("cents", F.lit(None).cast("long"))
    days = day_states(prices)
    spans = days.groupBy("contract_id").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    begins = {w: F.coalesce(plus_seconds(F.col("forecast_ts"), -s if isinstance(s, Column) else -s), F.col("forecast_ts")) for w, s in windows.items()}
    asked = rows.select(*KEYS, "forecast_ts", *[b.alias(f"begin_{w}") for w, b in begins.items()]).join(spans, "contract_id")
    asked = asked.where(day_number(F.col("forecast_ts")) >= F.col("from")).withColumn("end_day", day_number(F.col("forecast_ts")))

    # Days counted from the contract's first; a window's whole days lie between the days of its ends.
    size, end = F.col("to") - F.col("from") + 1, F.col("end_day") - F.col("from")
    levels = F.ceil(F.log2(size.cast("double"))).cast("int")
    clipped = lambda d: F.least(F.greatest(d, F.lit(0)), size)
    ranges = {w: clipped(day_number(F.col(f"begin_{w}")) - F.col("from") + 1) for w in windows} | {HISTORY: F.lit(0)}
    whole = F.array(*[F.struct(F.lit(w).alias("window"), _nodes(begin, clipped(end), levels).alias("nodes")) for w, begin in ranges.items()])
    wanted = asked.select(*KEYS, F.explode(whole).alias("x")).select(*KEYS, "x.window", F.explode("x.nodes").alias("x")).select(*KEYS, "window", "x.*")
    from_nodes = wanted.join(day_tree(days), ["contract_id", "level", "index"]).select(*KEYS, "window", *STATE)

    # The days in which a window begins or ends, each once a row, with their trades up to the forecast.
    edge = F.array_distinct(F.array("end_day", *[day_number(F.col(f"begin_{w}")) for w in windows]))
    edges = asked.select(*KEYS, "forecast_ts", "end_day", *[f"begin_{w}" for w in windows], F.explode(edge).alias("day"))
    trades = prices.select("contract_id", "trade_id", "source_ts", "price", "cents", "volume").withColumn("day", day_number(F.col("source_ts")))
    met = edges.join(trades, ["contract_id", "day"]).where(F.col("source_ts") <= F.col("forecast_ts"))
    # A whole day of one window may be another's first.
    inside = {w: (F.col("source_ts") >= F.col(f"begin_{w}")) & ((F.col("day") == F.col("end_day")) | (F.col("day") == day_number(F.col(f"begin_{w}")))) for w in windows} | {HISTORY: F.col("day") == F.col("end_day")}
    holds = F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in inside.items()]))
    from_trades = met.withColumn("window", F.explode(holds)).groupBy(*KEYS, "window").agg(*_trade_states())

    both = from_nodes.unionByName(from_trades).groupBy(*KEYS, "window").agg(*_merged_states())
    return both.groupBy(*KEYS).agg(*[F.first(F.when(F.col("window") == w, F.struct(*STATE)), ignorenulls=True).alias(w) for w in (*windows, HISTORY)])


def deviation(state: str) -> Column:
    """The sample deviation of the prices of a state; null below two."""
    m = F.col(state)["moments"]
    return F.when(m["k"] >= 2, F.sqrt(F.greatest(m["m2"], F.lit(0.0)) / (m["k"] - 1)))
