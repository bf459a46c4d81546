"""Exact nearest neighbours by Euclidean distance, as a join of blocks.

Queries are dealt to blocks of QUERY_BLOCK and candidates to strips whose number grows with the root of the
candidates', so that the copies of both sides and the partial results grow alike. A cell is a block against a strip;
its rows reach a task sorted, queries first, and the candidates pass by in Arrow batches, so that memory follows the
block and not the strip. In a cell, vectors are rounded to eight bits with a scale of their own. A tile's products of
these give all distances with a bound, the norms of both rounding errors; a pair is left out only if its least possible
distance is beyond the query's k-th smallest upper bound, or k-th distance found so far. All others are computed again
from the original vectors in double precision and go to heaps of k. The heaps of a query's cells are merged at the end.

Of equal vectors, only the k + 1 with the smallest ids (k besides a query itself) can be among the k nearest of
anything; the others are left out ahead, by a ranking that Spark limits before it shuffles.

Defined cases: vectors that are null, zero, or hold null or non-finite entries take no part; nor do vectors shorter
than the longest, which lack entries. A query's own row is no candidate, another row with the same id is. Ties go to
the smaller id, null ids last, then to the earlier row. Rows with a repeated query id each have their own result. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize
from tidemark.llm.whitening import usable

QUERY_BLOCK, STRIP_ROWS = 32768, 64
#: Queries and candidates of a tile, pairs that are computed again at a time, and dimensions whose products of eight-bit values single precision adds exactly.
TILE_QUERIES, TILE_ROWS, PAIRS, EXACT_DIMENSIONS = 512, 4096, 1 << 16, 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: eight-bit codes (held as single precision for the product), scale, squared norm of scale * codes, and an upper bound of the norm of what is lost."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # a row of numbers too small to be divided
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127)
    near = codes * scale[:, None]
    lost = x - near
    return codes.astype(np.float32), scale, (near * near).sum(1), np.sqrt((lost * lost).sum(1)) * (1 + 1e-9) + 1e-12 * np.sqrt((x * x).sum(1))


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of codes (row by row), exact: single precision holds sums below 2^24."""
    parts = [a[:, k : k + EXACT_DIMENSIONS] @ b[:, k : k + EXACT_DIMENSIONS].T for k in range(0, a.shape[1], EXACT_DIMENSIONS)]
    return sum(p.astype(np.float64) for p in parts)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, squares added in the order of the dimensions."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += (x - y) ** 2
    return np.sqrt(total)


class Nearest:
    """Heaps of the k nearest of a block of queries. An entry is (-distance, -rank of the id, id)."""

    def __init__(self, rows: np.ndarray, uids: np.ndarray, k: int):
        self.rows, self.uids, self.k = rows, uids, k
        self.codes, self.scale, self.norm, self.lost = quantise(rows)
        self.heaps: list[list[tuple]] = [[] for _ in uids]
        self.worst = np.full(len(uids), np.inf)
        self.at = {u: i for i, u in enumerate(uids.tolist())}

    def offer(self, i: int, distance: float, vec_id: int | None, uid: int) -> None:
        heap, entry = self.heaps[i], (-distance, vec_id is not None, -(vec_id or 0), -uid)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.worst[i] = -heap[0][0]

    def see(self, rows: np.ndarray, uids: np.ndarray, ids: list[int | None]) -> None:
        codes, scale, norm, lost = quantise(rows)
        own = [(self.at[u], j) for j, u in enumerate(uids.tolist()) if u in self.at]
        for first in range(0, len(self.uids), TILE_QUERIES):
            part = slice(first, first + TILE_QUERIES)
            with np.errstate(over="ignore", invalid="ignore"):
                squares = self.norm[part, None] + norm - 2 * self.scale[part, None] * scale * tile_products(self.codes[part], codes)
            # What rounding can make of the three terms goes into the bound too.
            slack = np.sqrt(1e-14 * (self.norm[part, None] + norm))
            near = np.sqrt(np.maximum(squares, 0))
            bound = self.lost[part, None] + lost + slack
            upper = near + bound
            for i, j in own:
                if first <= i < first + TILE_QUERIES:
                    upper[i - first, j] = np.inf
            limit = np.partition(upper, self.k - 1, axis=1)[:, self.k - 1] if upper.shape[1] > self.k else np.full(len(upper), np.inf)
            # A bound that isn't a number leaves nothing out.
            again = ~(near - bound > np.minimum(limit, self.worst[part])[:, None])
            for i, j in own:
                if first <= i < first + TILE_QUERIES:
                    again[i - first, j] = False
            places = np.flatnonzero(again)
            for k in range(0, len(places), PAIRS):
                i, j = np.divmod(places[k : k + PAIRS], again.shape[1])
                i += first
                found = distances(self.rows[i], rows[j])
                closer = found <= self.worst[i]
                i, j, found = i[closer], j[closer], found[closer]
                # Of each query only its k nearest of these need reach the heap.
                keys = np.array([ids[x] if ids[x] is not None else np.iinfo(np.int64).max for x in j], np.int64)
                order = np.lexsort((uids[j], keys, [ids[x] is None for x in j], found, i)) if len(i) else np.zeros(0, np.int64)
                i, j, found = i[order], j[order], found[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                for x, y, d in zip(i[rank < self.k].tolist(), j[rank < self.k].tolist(), found[rank < self.k].tolist(), strict=True):
                    self.offer(x, d, ids[y], int(uids[y]))

    def results(self) -> Iterator[tuple[int, float, int | None, int]]:
        for uid, heap in zip(self.uids.tolist(), self.heaps, strict=True):
            for d, known, vec_id, other in heap:
                yield uid, -d, -vec_id if known else None, -other


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.values.to_numpy()[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(len(vectors), -1).astype(np.float64)


def _cells(k: int):
    """Sorted rows of cells (cell, side, uid, vec_id, vector) to the k nearest of each query in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, block = None, [], None

        def results() -> Iterator[pa.RecordBatch]:
            if block is not None and (rows := list(block.results())):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["query", "score", "vec_id", "uid"])

        for batch in batches:
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])]).tolist() + [len(cells)] if len(cells) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if cells[a] != cell:
                    yield from results()
                    cell, queries, block = cells[a], [], None
                uids, rows = batch.column(2).slice(a, b - a).to_numpy(), _matrix(batch.column(4).slice(a, b - a))
                if sides[a] == 0:
                    queries.append((rows, uids))
                    continue
                if block is None and queries:
                    block = Nearest(np.concatenate([x for x, _ in queries]), np.concatenate([u for _, u in queries]), k)
                if block is not None:
                    ids = batch.column(3).slice(a, b - a).to_pylist()
                    for first in range(0, len(ids), TILE_ROWS):
                        block.see(rows[first : first + TILE_ROWS], uids[first : first + TILE_ROWS], ids[first : first + TILE_ROWS])
        yield from results()

    return run


def _merge(k: int):
    """Rows sorted by query to its k nearest with their ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []

        def ranked() -> list[tuple[int, int, int | None, float]]:
            return [(query, n, -v if known else None, -d) for n, (d, known, v, _) in enumerate(sorted(heap, reverse=True), 1)]

        for batch in batches:
            out = []
            for of, score, vec_id, uid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != query:
                    out += ranked()
                    query, heap = of, []
                entry = (-score, vec_id is not None, -(vec_id or 0), -uid)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            yield _ranked_batch(out)
        yield _ranked_batch(ranked())

    return run


def _ranked_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query", "rank", "vec_id", "score"])


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of each row for which ``is_query`` holds."""
    kept = usable(rows, vector_col).where(F.exists(vector_col, lambda c: c != 0))
    kept = kept.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector_col).cast(rows.schema[vector_col].dataType).alias("vector"))
    kept = materialize(kept, "vectors")
    n_queries, n_rows = kept.agg(F.count_if("is_query"), F.count(F.lit(1))).first()
    copies = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last(), "uid")
    candidates = kept.select("uid", "id", "vector").withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n")
    blocks, strips = max(1, math.ceil(n_queries / query_block)), max(1, math.ceil((n_rows / strip_rows) ** 0.5))

    def dealt(frame: DataFrame, side: int, own: Column, others: Column) -> DataFrame:
        made = frame.select("uid", "id", "vector", own.alias("own"), F.explode(others).alias("other"))
        cell = F.col("own") * strips + F.col("other") if side == 0 else F.col("other") * strips + F.col("own")
        return made.select(cell.alias("cell"), F.lit(side).alias("side"), "uid", "id", "vector")

    of = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    cells = dealt(kept.where("is_query"), 0, of(blocks), each(strips)).union(dealt(candidates, 1, of(strips), each(blocks)))
    found = cells.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_cells(k), "query long, score double, vec_id long, uid long")
    merged = found.repartition("query").sortWithinPartitions("query").mapInArrow(_merge(k), "query long, rank int, vec_id long, score double")
    ids = kept.where("is_query").select(F.col("uid").alias("query"), F.col("id").alias("query_id"))
    return merged.join(ids, "query").select("query_id", "rank", "vec_id", "score")
