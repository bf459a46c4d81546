"""Mixing sources to target weights by Pfair scheduling.

Each source has a target line: the blocks it should have run after t slots. While all sources last, that is w * t; a
source that has run out leaves the rotation and the others share its slots by their weights. The lines of all sources
sum to t and end at the sources' blocks, so every block has a slot. Block k is released where its source's line reaches
k (rounded down) and due where it reaches k + 1 (rounded up); earliest deadline first among the released blocks fills
every slot and meets all deadlines, so that after any number of slots each source is under one block off its line. The
lines are exact integers over the unrounded weights. One task makes a row per block, with memory that follows the
number of sources; the rows of the table are numbered from counts per source and hash range, so no source meets in
one task.

With a table of weights, :func:`schedule` repeats a cycle of whole slots per source instead and marks the prefix at
these weights; the cycle is no shorter than the stream, so its rounding stays under one block.

Defined cases: a null source is the empty source; ties in the order (repeated rows) take numbers in any order; null
texts count as rows; an empty table gives an empty table; other columns are ignored, and kept by :func:`mix`.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, text_hash

BLOCK_ROWS = 16
#: Target weights without a given table: rows of the source to this power.
TEMPERATURE = 0.7
CYCLE = 4096
MAX_SOURCES = 1 << 17
#: Rows of one source that are numbered in one task, about.
RANGE_ROWS = 4096


def quantize(weights: dict[str, float], slots: int = CYCLE) -> dict[str, int]:
    """Whole slots of a cycle for each source: largest remainders, at least one each, summing to the cycle's length."""
    slots = max(slots, 16 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * slots for s, w in weights.items()}
    quanta = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (quanta[s] - exact[s], s))
    while (rest := slots - sum(quanta.values())) != 0:
        for s in order if rest > 0 else reversed(order):
            if rest and quanta[s] + (step := 1 if rest > 0 else -1) >= 1:
                quanta[s] += step
                rest -= step
    return quanta


def cycle_slots(weights: dict[str, float], blocks: int) -> int:
    """A cycle's length: no shorter than the stream, and a whole slot or more for each source, so that rounding to slots moves no source by a block."""
    least = sum(weights.values()) / min(weights.values())
    return max(CYCLE, 1 << max(0, math.ceil(math.log2(max(1, blocks, least)))))


def pfair_cycle(quanta: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) for each slot of a cycle, by earliest deadline first among the released blocks."""
    cycle = sum(quanta.values())
    released: list[tuple[int, str, int]] = []
    waiting = [(0, -(-cycle // q), s, 0) for s, q in quanta.items()]
    heapq.heapify(waiting)
    out = []
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, k = heapq.heappop(waiting)
            heapq.heappush(released, (deadline, s, k))
        _, s, k = heapq.heappop(released)
        out.append((s, k))
        if k + 1 < quanta[s]:
            q = quanta[s]
            heapq.heappush(waiting, ((k + 1) * cycle // q, -(-(k + 2) * cycle // q), s, k + 1))
    return out


def whole_stream(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) for each slot until all sources have run out, by earliest deadline first."""
    names = sorted(blocks)
    exact = [Fraction(weights[s]) for s in names]
    if any(x <= 0 for x in exact):
        raise ValueError("weights must be positive")
    scale = math.lcm(*[x.denominator for x in exact])
    w, n = [int(x * scale) for x in exact], [blocks[s] for s in names]
    ends = sorted(range(len(names)), key=lambda i: Fraction(n[i], w[i]))
    active, ended = [sum(w)], [0]
    for i in ends:
        active.append(active[-1] - w[i])
        ended.append(ended[-1] + n[i])
    stage = [0] * len(names)

    def reached(i: int, k: int) -> tuple[int, int]:
        """The time at which the line of source i reaches k, rounded down and up."""

        def lasts(e: int) -> bool:
            return n[ends[e]] * w[i] >= k * w[ends[e]]

        if not lasts(stage[i]):
            stage[i] = bisect_left(range(len(ends)), True, lo=stage[i] + 1, key=lasts)
        slots, part = divmod(k * active[stage[i]], w[i])
        return ended[stage[i]] + slots, ended[stage[i]] + slots + (part > 0)

    waiting = [(0, i, 0, *reached(i, 1)) for i in range(len(names))]
    heapq.heapify(waiting)
    released: list[tuple[int, int, int, int, int]] = []
    for slot in range(sum(n)):
        while waiting and waiting[0][0] <= slot:
            release, i, k, down, up = heapq.heappop(waiting)
            heapq.heappush(released, (up, i, k, release, down))
        deadline, i, k, release, down = heapq.heappop(released)
        yield names[i], k, release, deadline, slot
        if k + 1 < n[i]:
            heapq.heappush(waiting, (down, i, k + 1, *reached(i, k + 2)))


def target_weights(counts: dict[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    return {s: n**temperature for s, n in counts.items()}


def _counts(docs: DataFrame, source_col: str) -> dict[str, int]:
    rows = docs.groupBy(_source(source_col).alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    return {r["s"]: r["count"] for r in rows}


def _source(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def _numbered(docs: DataFrame, counts: dict[str, int], block_rows: int, doc_col: str, source_col: str, range_rows: int, extra: list[Column] | None = None) -> DataFrame:
    """doc, extra, s, n (the row's number in its source), block.

    Rows are numbered within hash ranges of about ``range_rows`` rows. A range that repeated or null ids overfill is split by a number that its rows were written with, so a window never holds more than a few times ``range_rows`` rows; their starts are summed in two steps, over stretches of ranges and within them.
    """
    bits = max(0, math.ceil(math.log2(max(1, sum(counts.values()) / range_rows))))
    h = F.xxhash64(F.col(doc_col))
    rows = docs.select(F.col(doc_col).alias("doc"), *(extra or []), _source(source_col).alias("s"), h.alias("h"), (F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")).alias("range"))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    few = len(counts) << bits <= 1 << 17
    sizes = rows.groupBy("s", "range").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * range_rows)).alias("subs")).where("subs > 1")
    # At most rows / (4 * range_rows) ranges are overfull: none where ids differ.
    rows = rows.join(F.broadcast(sizes) if few else sizes, ["s", "range"], "left")
    rows = rows.withColumn("sub", F.when(F.col("subs").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("uid"), F.col("subs")))).drop("subs")
    sums = rows.groupBy("s", "range", "sub").count().withColumn("stretch", F.shiftright("range", 12))
    inside = Window.partitionBy("s", "stretch").orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("s").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums.groupBy("s", "stretch").agg(F.sum("count").alias("t")).select("s", "stretch", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    starts = sums.withColumn("start", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(stretches, ["s", "stretch"])
    starts = starts.select("s", "range", "sub", (F.col("start") + F.col("base")).alias("start"))
    starts = F.broadcast(starts) if few else starts
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("s", "range", "sub").orderBy("h", "doc", "uid")) - 1).join(starts, ["s", "range", "sub"])
    return rows.withColumn("n", F.col("n") + F.col("start")).withColumn("block", F.floor(F.col("n") / block_rows))


def _weights(counts: dict[str, int], weights: dict[str, float] | None, temperature: float) -> dict[str, float]:
    given = weights or target_weights(counts, temperature)
    if missing := sorted(set(counts) - set(given)):
        raise ValueError(f"no weight for {missing[:5]}")
    return {s: given[s] for s in counts}


def whole_schedule(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, doc_col: str = "doc_id", source_col: str = "source", range_rows: int = RANGE_ROWS, extra: list[Column] | None = None) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, place (in the block), in_mix (true), and ``extra`` columns (named __...): a row per row of ``docs``. A source that has run out leaves the rotation."""
    counts = _counts(docs, source_col)
    given = _weights(counts, weights, temperature)
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    schema = "s string, block long, release long, deadline long, slot long"
    names = ["s", "block", "release", "deadline", "slot"]

    def deal(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = whole_stream(blocks, given) if blocks else iter(())
        while rows := list(islice(stream, 1 << 14)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 0 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))], names)

    slots = materialize(docs.sparkSession.range(0, 1, 1, 1).mapInArrow(deal, schema), "slots")
    rows = _numbered(docs, counts, block_rows, doc_col, source_col, range_rows, extra).join(slots, ["s", "block"])
    more = [F.col(c) for c in rows.columns if c.startswith("__")]
    return rows.select(F.col("doc").alias(doc_col), F.col("s").alias(source_col), "block", "release", "deadline", "slot", F.pmod(F.col("n"), F.lit(block_rows)).cast("int").alias("place"), F.lit(True).alias("in_mix"), *more)


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, doc_col: str = "doc_id", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, place (in the block), in_mix: a row per row of ``docs``.

    Without ``weights`` they follow ``temperature``, and this is :func:`whole_schedule`. ``weights`` must name every source; all sources then keep being scheduled to their ends in the same cycle, and in_mix holds up to the first slot whose source has run out, which is where the stream stops being at the given weights. The driver makes this cycle, as long as the stream or longer; for many rows use :func:`whole_schedule`.
    """
    if not weights:
        return whole_schedule(docs, None, temperature, block_rows, doc_col, source_col, range_rows)
    spark = docs.sparkSession
    counts = _counts(docs, source_col)
    given = _weights(counts, weights, temperature)
    quanta = quantize(given, cycle_slots(given, sum(-(-n // block_rows) for n in counts.values()))) if counts else {}
    cycle = sum(quanta.values())
    slots = [(s, k, slot) for slot, (s, k) in enumerate(pfair_cycle(quanta))] if counts else []
    at = {(s, k): slot for s, k, slot in slots}
    ends = []
    for s, n in counts.items():
        rounds, k = divmod(-(-n // block_rows), quanta[s])
        ends.append(rounds * cycle + at[s, k])
    pattern = spark.createDataFrame([(s, k, slot, quanta[s]) for s, k, slot in slots], T.StructType.fromDDL("s string, k long, at long, q long"))

    rows = _numbered(docs, counts, block_rows, doc_col, source_col, range_rows)
    quota = spark.createDataFrame(list(quanta.items()), T.StructType.fromDDL("s string, q long"))
    rows = rows.join(F.broadcast(quota), "s").withColumn("k", F.pmod("block", "q"))
    rows = rows.join(F.broadcast(pattern.drop("q")), ["s", "k"])
    slot = F.expr(f"(block div q) * {cycle} + at")
    return rows.select(
        F.col("doc").alias(doc_col),
        F.col("s").alias(source_col),
        F.col("block").cast("long").alias("block"),
        F.expr(f"(block * {cycle}) div q").alias("release"),
        F.expr(f"((block + 1) * {cycle} + q - 1) div q").alias("deadline"),
        slot.alias("slot"),
        F.pmod(F.col("n"), F.lit(block_rows)).cast("int").alias("place"),
        (slot < F.lit(min(ends, default=0))).alias("in_mix"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, doc_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """All rows of ``docs``, dealt and sorted by slot and place: any prefix of the stream holds each source's target to within a block, and a source that has run out leaves the rotation. Rows are known by id, source and text; those that agree in all three take their turns in any order."""
    plan = whole_schedule(docs, weights, temperature, doc_col=doc_col, source_col=source_col, extra=[text_hash(F.col(text_col)).alias("__hash")], **options)
    turn = F.row_number().over(Window.partitionBy(doc_col, source_col, "__hash").orderBy("slot", "place"))
    plan = plan.select(F.col(doc_col).alias("__doc"), F.col(source_col).alias("__s"), F.col("__hash").alias("__h"), F.struct("slot", "place").alias("__at"), turn.alias("__k"))
    rows = docs.withColumns({"__source": _source(source_col), "__text": text_hash(F.col(text_col))})
    rows = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(doc_col, "__source", "__text").orderBy(F.lit(1))))
    joined = rows.join(plan, rows[doc_col].eqNullSafe(plan["__doc"]) & (F.col("__source") == F.col("__s")) & (F.col("__text") == F.col("__h")) & (F.col("__turn") == F.col("__k")))
    return joined.repartitionByRange("__at").sortWithinPartitions("__at").select(*docs.columns)


def stream_order(docs: DataFrame) -> list[Column]:
    """The place of each row of a stream that :func:`mix` ordered and that was written and read again: the file's number and the row's place in it. For a frame that isn't read from files, the order in which its rows come."""
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"])
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    name = meta["file_name"]
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"), name, meta["row_index"]]
