"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of ``edges`` (columns u and v) but the roots themselves.

    Alternating large-star and small-star steps: each replaces edges by as many or fewer edges to smaller nodes, so
    that the work of a round is a few shuffles of the edges, and the rounds are about the logarithm of the longest
    path. No component meets in one task. Every round is written to the shared folder.
    """
    stars = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        digest = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if digest == before or digest["n"] == 0:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = digest
        after = materialize(_small_star(_large_star(stars)), "edges")
        discard(stars)
        stars = after


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _with_least(down)
    moved = seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(seen.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
