"""Sharding by extendible hashing.

The directory is indexed by the first G bits of a 60-bit hash of the id. Byte counts per directory cell are summed in
Spark, folded to every shorter prefix, and a cell's shard is its shortest prefix that fits the limit: only oversized
buckets are split on another bit. Cells too full at G bits get a directory of eight more bits for their own rows, down
to the last bit. What no bit can split (rows with one id) goes to overflow pages that fit as well. A single row above
the limit has a shard to itself.

Defined cases: a null text has 0 bytes; null ids hash as the text ``null``; repeated rows share a bucket and spread
over pages once it is full; an empty table gives an empty table; other columns are kept by :func:`assign_shards`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize

HASH_BITS = 60
MAX_SHARD_BYTES = 16 << 20
#: A directory of up to so many cells (16 bytes each) goes to all executors; a larger one is joined by a shuffle.
MAX_BROADCAST_CELLS = 1 << 20


def hash_bits(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("h", HASH_BITS - bits)


def _directory(rows: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """cell, depth (null: too full at ``bits``): for each cell of ``bits`` bits its shortest prefix of at least ``low`` bits that fits."""
    cells = rows.groupBy(_prefix(bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    depths = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("d"))
    depths = depths.withColumn("p", F.expr(f"shiftright(cell, {bits} - d)"))
    fits = depths.groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).where((F.col("b") <= limit) | (F.col("n") == 1)).select("d", "p")
    return depths.select("cell", "d", "p").join(fits.withColumn("fit", F.lit(True)), ["d", "p"], "left").groupBy("cell").agg(F.min(F.when(F.col("fit"), F.col("d"))).alias("depth"))


def _directories(rows: DataFrame, limit: int, max_broadcast_cells: int) -> tuple[list[tuple[int, DataFrame, bool]], bool]:
    """(bits, directory, whether it may be broadcast) for each level, and whether rows are left that no bit can split. rows: h and n_bytes, written."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    low, bits = 0, min(HASH_BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 6))
    levels: list[tuple[int, DataFrame, bool]] = []
    while True:
        found = materialize(_directory(rows, low, bits, limit), "directory")
        small = found.count() <= max_broadcast_cells
        levels.append((bits, found, small))
        if found.where(F.col("depth").isNull()).limit(1).count() == 0:
            return levels, False
        if bits == HASH_BITS:
            return levels, True
        open_cells = found.where(F.col("depth").isNull()).select("cell")
        rows = materialize(rows.join(F.broadcast(open_cells) if small else open_cells, _prefix(bits) == F.col("cell"), "left_semi"), "split")
        low, bits = bits + 1, min(HASH_BITS, bits + 8)


def _placed(rows: DataFrame, levels: list[tuple[int, DataFrame, bool]], full: bool, limit: int) -> DataFrame:
    """rows (with __h and __bytes) with __shard and __depth: each row looks its prefix up, level by level; only overflow pages need the rows of a bucket together, and those of one input partition at a time."""
    if full:  # numbered where they are read, before a join brings the rows of an id together
        rows = rows.withColumn("__part", F.spark_partition_id())
    depth = F.lit(None).cast("int")
    for k, (bits, found, small) in enumerate(levels):
        found = found.select(F.col("cell").alias(f"__cell{k}"), F.col("depth").cast("int").alias(f"__depth{k}"))
        rows = rows.join(F.broadcast(found) if small else found, F.shiftright("__h", HASH_BITS - bits) == F.col(f"__cell{k}"), "left")
        depth = F.coalesce(depth, F.col(f"__depth{k}"))
    rows = rows.withColumn("__depth", depth).drop(*[f"__{x}{k}" for k in range(len(levels)) for x in ("cell", "depth")])
    placed = rows.withColumn("__shard", F.expr(f"concat(__depth, ':', shiftright(__h, {HASH_BITS} - __depth))"))
    if not full:
        return placed
    return placed.where("__depth IS NOT NULL").drop("__part").unionByName(_pages(rows.where("__depth IS NULL"), limit))


def _pages(full: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets that have used up all bits. Numbering runs within the partitions that rows were read in (__part), so no bucket meets in one task."""
    part = Window.partitionBy("__h", "__part")
    numbered = full.withColumn("__row", F.row_number().over(part.orderBy("__bytes")) - 1).withColumn("__most", F.max("__bytes").over(part))
    page = F.floor(F.col("__row") / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("__most"), F.lit(1)))))
    paged = numbered.withColumn("__depth", F.lit(HASH_BITS)).withColumn("__shard", F.concat(F.lit(f"{HASH_BITS}:"), F.col("__h"), F.lit(":"), F.col("__part"), F.lit("."), page))
    return paged.drop("__part", "__row", "__most")


def _sized(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"__h": hash_bits(F.col(doc_col)), "__bytes": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")})


def shard_ids(docs: DataFrame, max_shard_bytes: int = MAX_SHARD_BYTES, doc_col: str = "doc_id", text_col: str = "text", max_broadcast_cells: int = MAX_BROADCAST_CELLS) -> DataFrame:
    """doc_id, n_bytes, shard_id ("depth:prefix", with ":page" after it on an overflow page), depth, a row per row of ``docs``."""
    rows = materialize(_sized(docs, doc_col, text_col).select(F.col(doc_col).alias("id"), "__h", "__bytes"), "sized")
    levels, full = _directories(rows.select(F.col("__h").alias("h"), F.col("__bytes").alias("n_bytes")), max_shard_bytes, max_broadcast_cells)
    placed = _placed(rows, levels, full, max_shard_bytes)
    return placed.select(F.col("id").alias(doc_col), F.col("__bytes").alias("n_bytes"), F.col("__shard").alias("shard_id"), F.col("__depth").alias("depth"))


def assign_shards(docs: DataFrame, max_shard_bytes: int = MAX_SHARD_BYTES, doc_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None, max_broadcast_cells: int = MAX_BROADCAST_CELLS) -> DataFrame:
    """``docs`` with a column shard_id (in place of one that was there), dealt so that each shard is written by one task, its rows in the order of ``order`` where that is given. The shard follows from the id's hash and the directory, so rows don't have to meet."""
    kept = [c for c in docs.columns if c != "shard_id"]
    if order:
        docs = docs.withColumn("__order", F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)]))
    rows = _sized(docs, doc_col, text_col)
    thin = materialize(rows.select(F.col("__h").alias("h"), F.col("__bytes").alias("n_bytes")), "sized")
    levels, full = _directories(thin, max_shard_bytes, max_broadcast_cells)
    dealt = _placed(rows, levels, full, max_shard_bytes).repartition("__shard")
    dealt = dealt.sortWithinPartitions("__shard", "__order") if order else dealt
    return dealt.select(*[F.col(f"`{c}`") for c in kept], F.col("__shard").alias("shard_id"))
