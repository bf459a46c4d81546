"""SimHash near-duplicates by anchor-point covering.

The anchors are the code words of the perfect Hamming code over the low 63 bits of a fingerprint: every 63-bit word is
within covering radius 1 of one anchor. Two fingerprints that differ in at most 2 bits have a word between them that
differs from each in at most 1 bit, so the anchor of that word is within 1 + 1 = 2 bits of both: each side needs the
covering radius plus its half of the threshold. A fingerprint therefore goes to its 32 anchors (one if it is an anchor
itself) and linked pairs always meet. An anchor sees at most 2 * (1 + 63 + 1953) different fingerprints, whatever the
corpus, so comparing per anchor is bounded; it passes on one edge per member, to the least member of its cluster there,
not pairs. Equal fingerprints are one row before all this.

Defined cases: a null or empty text, or one without words, has fingerprint 0; fewer words than the shingle are one
shingle; repeated rows each get a row; null ids get a row and name a component only where it has no other id (null);
rows under one id (or without one) are told apart by their texts; an empty table gives an empty table; other columns
are ignored, and kept by :func:`keep_one_per_group`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_hash
from tidemark.llm.graph import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
LOW = (1 << 63) - 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, a megabyte of text at a time."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text over XXH64 of its word shingles, repeats included; bytes.split parts at the same six spaces."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_chunks((text or "").encode().lower()):
        words = tail + words
        if len(words) >= SHINGLE:
            line = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(lengths)
            starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
            stops = (ends[SHINGLE - 1 :] - 1).tolist()
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
            n += len(hashes)
            for k in range(0, len(hashes), 8192):
                counts += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        tail = words[-(SHINGLE - 1) :]
    if n == 0:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
        kept = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(found.view(np.int64))], [*[batch.schema.names[k] for k in kept], "fp"])


def _flips() -> np.ndarray:
    """For each syndrome the 32 patterns of at most 2 bits that lead to an anchor: the bit it names, and the pairs whose places XOR to it."""
    rows = np.zeros((64, 32), np.uint64)
    for s in range(1, 64):
        pairs = [(i, i ^ s) for i in range(1, 64) if i < i ^ s and i != s]
        rows[s] = [1 << (s - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs)]
    return rows


_FLIPS = _flips()
_PARITY = np.array([sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1) for k in range(6)], np.uint64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for each anchor within 2 bits of each fingerprint (uint64)."""
    low = fps & np.uint64(LOW)
    syndrome = np.zeros(len(fps), np.int64)
    for k in range(6):
        syndrome |= (np.bitwise_count(low & _PARITY[k]) & 1).astype(np.int64) << k
    off = syndrome > 0
    many = (_FLIPS[syndrome[off]] ^ low[off][:, None]).ravel()
    return np.concatenate([low[~off], many]), np.concatenate([fps[~off], np.repeat(fps[off], 32)])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, fps = anchors(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fps.view(np.int64))], ["anchor", "fp"])


def cluster(fps: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member of its cluster) under links of at most MAX_BITS, without the least ones. fps: int64, ascending, distinct."""
    words, out = fps.view(np.uint64), []
    left = np.arange(len(fps))
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(words[left] ^ words[todo.pop()]) <= MAX_BITS
            if near.any():
                out += [(int(fps[k]), int(fps[root])) for k in left[near]]
                todo += left[near].tolist()
                left = left[~near]
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by anchor and fingerprint; an anchor may run over several batches."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def edges(at: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(at)])
        two = starts[sizes == 2]
        close = two[np.bitwise_count(fps[two].view(np.uint64) ^ fps[two + 1].view(np.uint64)) <= MAX_BITS]
        more = [e for k, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True) for e in cluster(fps[k : k + n])]
        u = np.concatenate([fps[close + 1], np.array([e[0] for e in more], np.int64)])
        v = np.concatenate([fps[close], np.array([e[1] for e in more], np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        at, fps = (np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held))
        last = np.searchsorted(at, at[-1]) if len(at) else 0
        held = (at[last:], fps[last:])
        yield edges(at[:last], fps[:last])
    yield edges(*held)


def _components(docs: DataFrame, doc_col: str, text_col: str, keys: list[Column]) -> DataFrame:
    """doc, the keys, fp, root (one for each component), component_id: a row per row of ``docs``."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in docs.select(F.col(doc_col).alias("doc"), *keys).dtypes)
    rows = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"), *keys).mapInArrow(_fingerprints, f"{kinds}, fp long")
    rows = materialize(rows, "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc").alias("least")), "classes")
    copies = classes.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    edges = copies.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_link, "u long, v long")
    stars = connected_components(edges)
    rooted = classes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select(F.col("fp").alias("class"), "root", "component_id")
    return rows.join(named, F.col("fp") == F.col("class")).drop("class")


def near_duplicates(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), component_id (the smallest id linked to it, itself included)."""
    return _components(docs, doc_col, text_col, []).select(F.col("doc").alias(doc_col), "fp", "component_id")


def keep_one_per_group(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id (none at all if no row has one), of several under that id the one with the least hash of its text."""
    key = text_hash(F.col(text_col)).alias("__text")
    rows = _components(docs, doc_col, text_col, [key]).groupBy("root", "doc", "__text").count()
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "__text", "count")).alias("x"))
    keep = materialize(first.select(F.col("x.doc").alias("__keep"), F.col("x.__text").alias("__same"), F.col("x.count").alias("__rows")), "keep")
    kept = docs.withColumn("__text", key)
    kept = kept.join(keep.drop("__rows"), kept[doc_col].eqNullSafe(keep["__keep"]) & (F.col("__text") == F.col("__same")), "left_semi")
    if keep.where("__rows > 1").limit(1).count() == 0:
        return kept.drop("__text")
    return kept.dropDuplicates([doc_col, "__text"]).drop("__text")
