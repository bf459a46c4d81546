"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, last_doc), one row per line key, bucketed and sorted by the two 64-bit hashes of
the key. Each batch of documents is merge-anti-joined with the runs and written once: keys that no run holds are a new
run at level 0, so that every key is in one run alone; the others, marked as known, are updates of counts. Once a level
holds ``fanout`` runs they are compacted into one run of the next, and with it if that fills it. Batches and runs have
the same buckets, so a batch meets the runs without a shuffle. :func:`dedup_lines` feeds all documents in batches and
then drops the lines that runs and updates condemn together.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points never drop; a null
id counts as one document that is never the keeper; repeated rows with one id count once and are treated alike; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, discard, materialize, work_dir

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: At most so many condemned keys (32 bytes each) go to all executors: those that hold at least this share of all rows.
MAX_BROADCAST_KEYS = 1 << 18
#: A batch has about so many line keys, but there are 4 batches at least and 32 at most.
BATCH_KEYS = 1 << 26
MIN_BATCHES, MAX_BATCHES = 4, 32


def line_keys(docs: DataFrame, min_chars: int, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, h1, h2: the hashes of each document's long enough line keys, each once per document."""
    lines = docs.select(F.col(doc_col).alias("doc"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line"))
    keys = lines.select("doc", ascii_lower(F.btrim(F.col("line"), F.lit(SPACE))).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc", *_hashes(F.col("key"))).distinct()


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(F.lit("\x01"), key)).alias("h2")]


def _python_hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(b"\x01" + key, 42)


class LineRuns:
    """The levels of runs, of which no two share a key, and the updates of their counts: the rows of batches that are marked as known. ``fanout`` runs of a level are compacted into one of the next."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        """A table of h1, h2, known, n_docs, last_doc."""
        name = f"tidemark_run_{uuid.uuid4().hex}"
        path = f"{work_dir(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("NOT known").drop("known")

    def _drop(self, name: str) -> None:
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        discard(run)

    def _merged(self, names: list[str]) -> DataFrame:
        """One table of runs that share no key: a merge of sorted buckets."""
        merged = self._run(names[0])
        for name in names[1:]:
            a, b = merged.alias("a"), self._run(name).alias("b")
            both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
            merged = both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("h1", "h2", "n_docs", "last_doc")])
        return merged.repartition(self.buckets, "h1", "h2").withColumn("known", F.lit(False))

    def add(self, keys: DataFrame, compact: bool = True) -> None:
        """Takes a batch's keys (doc, h1, h2, distinct) against the runs: the new ones become a run, the counts of the known ones an update. Compacts the levels that are full, in one merge if one fills the next; the last batch needs none, since no other meets its run."""
        run = self._write(self.split(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))))
        self.batches.append(run)
        self.levels = self.levels or [[]]
        self.levels[0].append(run)
        full: list[str] = []
        level = 0
        while compact and len(self.levels[level]) + (level > 0) >= self.fanout:
            full, self.levels[level] = self.levels[level] + full, []
            level += 1
            if len(self.levels) == level:
                self.levels.append([])
        if full:
            self.levels[level].append(self._write(self._merged(full)))
            for name in full:
                if name not in self.batches:
                    self._drop(name)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def split(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` with ``known``: whether a run holds the key. Each run is met by a merge."""
        known = F.lit(False)
        for k, name in enumerate(self.names()):
            keys = keys.join(self._run(name).select("h1", "h2", F.lit(True).alias(f"__{k}")), ["h1", "h2"], "left")
            known = known | F.col(f"__{k}").isNotNull()
        return keys.withColumn("known", known).drop(*[f"__{k}" for k in range(len(self.names()))])

    def anti_join(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key no run holds."""
        return self.split(keys).where("NOT known").drop("known")

    def compacted(self, min_docs: int = 1) -> DataFrame | None:
        """h1, h2, n_docs, last_doc of all keys in at least ``min_docs`` documents; None without any run. A run meets the sums of the updates, which are as many as the repeated keys."""
        out = None
        more = None
        for name in self.batches[1:]:
            update = self.spark.table(name).where("known")
            more = update if more is None else more.unionByName(update)
        if more is not None:
            more = more.groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        for name in self.names():
            run = self._run(name)
            if more is not None:
                run = run.join(more, ["h1", "h2"], "left")
                run = run.select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))
            run = run.where(F.col("n_docs") >= min_docs)
            out = run if out is None else out.unionByName(run)
        return out

    def drop(self) -> None:
        """Drops all tables and their files."""
        for name in {*self.names(), *self.batches}:
            self._drop(name)
        self.levels, self.batches = [], []


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    n_batches: int | None = None,
    fanout: int = 2,
    doc_col: str = "doc_id",
    text_col: str = "text",
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is left): keys in at least ``min_docs`` documents keep only the lines of the largest id that holds them. The batches, by a hash of the id, arrive one after the other; without ``n_batches`` their number follows the count of keys.

    A condemned key that holds at least 1 / ``max_broadcast_keys`` of all key rows is broadcast; there can't be more of them than that. The others are joined by a shuffle, in which no key has more rows than this share.
    """
    spark = docs.sparkSession
    keys = materialize(line_keys(docs, min_chars, doc_col, text_col), "line-keys")
    n_keys = keys.count()
    batches = n_batches or min(MAX_BATCHES, max(MIN_BATCHES, -(-n_keys // BATCH_KEYS)))
    runs = LineRuns(spark, fanout)
    # Each batch filters all keys, which are a few bytes a line: a folder for each batch would take a file for each batch and task.
    part = F.pmod(F.xxhash64("doc"), F.lit(batches))
    for batch in range(batches):
        runs.add(keys.where(part == batch), compact=batch + 1 < batches)
    condemned = materialize(runs.compacted(min_docs), "condemned")
    runs.drop()
    heavy = F.col("n_docs") * max_broadcast_keys >= n_keys
    hit = keys.join(F.broadcast(condemned.where(heavy)), ["h1", "h2"])
    hit = hit.unionByName(keys.join(condemned.where(~heavy), ["h1", "h2"])).where(~F.col("doc").eqNullSafe(F.col("last_doc")))
    per_doc = materialize(hit.groupBy("doc").agg(F.collect_list("h1").alias("h1s"), F.collect_list("h2").alias("h2s")), "cuts")
    discard(keys)
    discard(condemned)
    rows = docs.select(F.col(doc_col).alias("id"), F.col(text_col).alias("text"))
    # A merge at any size: with a small table of cuts the same query would broadcast it and shuffle nothing, and say little about a large one.
    rows = rows.join(per_doc.hint("merge"), F.col("id").eqNullSafe(F.col("doc")), "left").select("id", "text", "h1s", "h2s")
    kind = docs.schema[doc_col].dataType.simpleString()
    left = rows.mapInArrow(lambda batches: _cut(batches, min_chars), f"id {kind}, n_lines long, n_dropped long, text string")
    return left.withColumnRenamed("id", doc_col)


def _cut(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        texts, firsts, seconds = (batch.column(k).to_pylist() for k in (1, 2, 3))
        for text, h1s, h2s in zip(texts, firsts, seconds, strict=True):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if h1s:
                gone = {(a % 2**64, b % 2**64) for a, b in zip(h1s, h2s, strict=True)}
                lines = [x for x in lines if not _gone(x, gone, min_chars)]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "text"])


def _gone(line: str, gone: set[tuple[int, int]], min_chars: int) -> bool:
    key = line.strip(SPACE)
    return len(key) >= min_chars and _python_hashes(key.encode().lower()) in gone
