"""Which tokens of two vocabularies cover the same bytes, for whole documents, by deduplicated segments.

Both tokenizers read a space and the text. It is cut before runs of white space, where :func:`safe_breaks` has shown
from both vocabularies that no token can reach over the cut; so a document's tokens are those of its segments, one
after the other. Each distinct segment of the corpus is tokenised and aligned once:

1. Tasks cut texts into segments and number them within blocks (BLOCK_BYTES of text; a longer text is a block of its
   own). A block has each of its segments once. Documents are bucketed by block and segments by themselves, so that
   neither is shuffled again.
2. Distinct segments are tokenised and aligned.
3. The alignments are joined back to the blocks by segment; with them a block counts in how many of its documents
   each pair of ids is linked, and the counts are summed.
4. Pair counts are joined to the distinct segments' links, and the segments' sums to the blocks, which compose their
   documents.

No key gathers a corpus: a block's rows are bounded, and a segment has one row a block.

Defined cases: null and empty texts, and texts that the tokens of either side don't spell (those with U+2581, which
the piece vocabulary has for a space), have no tokens, zeros and an empty ``groups``; strings of special tokens are
plain text; repeated rows each count as a document; an empty table gives an empty table; other columns are ignored. The tables
in the shared folder stay until the application's folder is cleared, since the result reads them.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import materialize, shuffles_freed, work_dir
from tidemark.llm.tokencount import _byte_letters

BLOCK_BYTES = 8 << 20
#: A block's segments are written as lists of this many.
SEGMENTS_A_ROW = 1024
#: Longer texts are counted by their distinct segments.
MAX_REPEATED = 1 << 16
#: Groups with more links than this are linked by different ids, with how often each occurs.
MAX_PRODUCT = 4096
#: White space that a cut may stand before, if both vocabularies allow it.
WHITE = " \n\t\r\x0b\x0c"
#: Nothing of these classes is taken for the end of a word, whatever a tokenizer takes for white space.
_ODD = {"Zs", "Zl", "Zp", "Cc", "Cf"}


def byte_vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    found = {n: bytes(letters[c] for c in s) for s, n in spec["model"]["vocab"].items() if all(c in letters for c in s)}
    return [found.get(n, b"") for n in range(max(found) + 1)]


def piece_model(path: str) -> tuple[bytes, list[bytes], list[str]]:
    """A piece vocabulary that adds no space of its own, the bytes of each id, and the pieces that merges can make."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    how = model.normalizer_spec
    if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the piece vocabulary changes its text, so segments can't stand for it")
    how.add_dummy_prefix = False
    kinds = type(model.pieces[0])
    data = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b"" for p in model.pieces]
    return model.SerializeToString(), data, [p.piece.replace("▁", " ") for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]


def _some(characters: frozenset[str] | str) -> str:
    return "".join(map(re.escape, sorted(characters)))


@cache
def odd_characters() -> frozenset[str]:
    """White space in the widest sense, and what a piece vocabulary writes for it: no cut stands behind one of these."""
    return frozenset({"▁"}) | {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() or unicodedata.category(c) in _ODD}


def safe_breaks(a: list[bytes], b: list[str]) -> str:
    """The characters of WHITE that stand behind something else than white space in no entry of either vocabulary: nothing merges over a cut before a run that begins with one. Part of a character counts as something else."""
    kept, odd = "", _some(odd_characters())
    entries = [s.decode(errors="surrogateescape") for s in a] + b
    for w in WHITE:
        inside = re.compile(f"[^{odd}]{re.escape(w)}")
        if not any(map(inside.search, entries)):
            kept += w
    return kept


class Cutter:
    """Cuts texts before runs of white space that begin with one of ``breaks`` and stand behind something else than white space."""

    def __init__(self, breaks: str):
        self.white = np.zeros(256, bool)
        self.white[list(breaks.encode())] = True
        self.odd = np.zeros(1 << 21, bool)
        self.odd[[ord(c) for c in odd_characters() - set(breaks)]] = True

    def starts(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where segments start in the UTF-8 of texts one after the other; ``texts``: where these start, none of which is empty."""
        white = self.white[data]
        at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        before = data[at - 1].astype(np.int32)
        long = np.flatnonzero(before >= 0x80)  # the characters before, from their last two, three or four bytes
        d, c, b, a = (data[np.maximum(at[long] - k, 0)].astype(np.int32) for k in (1, 2, 3, 4))
        d, two, three = d & 63, c >= 0xC0, b >= 0xE0
        c, b = np.where(two, c & 31, c & 63) << 6, np.where(three, b & 15, b & 63) << 12
        before[long] = np.where(two, c | d, np.where(three, b | c | d, (a & 7) << 18 | b | c | d))
        first = np.zeros(len(data), bool)
        first[at[~self.odd[before]]] = True
        first[texts] = True
        return np.flatnonzero(first)

    def __call__(self, text: str) -> list[str]:
        data = text.encode()
        cuts = [*self.starts(np.frombuffer(data, np.uint8), np.zeros(1, np.int64)).tolist(), len(data)] if data else []
        return [data[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def numbered(self, texts: pa.LargeStringArray) -> tuple[list[np.ndarray], pa.LargeStringArray]:
        """The segments of each text behind a space (none of a null or empty one) as numbers, and the distinct segments in the order of their numbers."""
        full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(full), pa.scalar("", pa.large_string()))
        if not len(spaced):
            return [np.zeros(0, np.uint32)] * len(texts), pa.array([], pa.large_string())
        ends = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, 8 * spaced.offset)
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        starts = self.starts(data, ends[:-1])
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(data)]), pa.py_buffer(data)).dictionary_encode()
        cuts = np.zeros(len(texts) + 1, np.int64)
        cuts[1:][full.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(starts, ends))
        return np.split(found.indices.to_numpy().astype(np.uint32), np.cumsum(cuts)[1:-1]), found.dictionary


def _packed(numbers: np.ndarray, segments: int) -> bytes:
    """Numbers below ``segments`` in two, three (low halves first) or four bytes each."""
    if segments > 1 << 24:
        return numbers.tobytes()
    low = numbers.astype(np.uint16).tobytes()
    return low if segments <= 1 << 16 else low + (numbers >> 16).astype(np.uint8).tobytes()


def _numbers(data: bytes, segments: int) -> np.ndarray:
    if segments > 1 << 24:
        return np.frombuffer(data, np.uint32)
    if segments <= 1 << 16:
        return np.frombuffer(data, np.uint16)
    n = len(data) // 3
    return np.frombuffer(data, np.uint16, n) + (np.frombuffer(data, np.uint8, n, 2 * n).astype(np.uint32) << 16)


def _bucketed(df: DataFrame, tag: str, buckets: int, by: str, partition: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by a column: what meets another of as many buckets isn't shuffled."""
    name = f"tidemark_{tag}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, by).sortBy(by).option("path", f"{work_dir(df.sparkSession)}/{name}").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def _blocks(docs: DataFrame, cutter: Cutter, doc_col: str, text_col: str) -> DataFrame:
    """kind "doc": block, doc, data (numbers of the text's segments in the block); kind "seg": block, k, segs (the segments from number k on)."""
    kind = docs.schema[doc_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, ids, texts, held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            doc = pa.concat_arrays(ids)
            numbers, distinct = cutter.numbered(pa.concat_arrays(texts))
            n, first = len(doc), np.arange(0, len(distinct), SEGMENTS_A_ROW)
            segs = pa.ListArray.from_arrays(pa.array(np.r_[first, len(distinct)], pa.int32()), distinct.cast(pa.string()))
            m = len(segs)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(["doc"] * n + ["seg"] * m), pa.array([base + number] * (n + m), pa.int64()), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(first, pa.int64())]),
                    pa.concat_arrays([doc, pa.nulls(m, doc.type)]), pa.array([_packed(x, len(distinct)) for x in numbers] + [None] * m, pa.binary()), pa.concat_arrays([pa.nulls(n, segs.type), segs]),
                ],
                ["kind", "block", "k", "doc", "data", "segs"],
            )

        for batch in batches:
            text, at = batch.column(1).cast(pa.large_string()), 0
            for row, size in enumerate(pc.fill_null(pc.utf8_length(text), 0).to_pylist()):
                if (ids or row > at) and held + size > BLOCK_BYTES:
                    ids.append(batch.column(0).slice(at, row - at))
                    texts.append(text.slice(at, row - at))
                    yield flush()
                    ids, texts, held, number, at = [], [], 0, number + 1, row
                held += size
            if batch.num_rows > at:
                ids.append(batch.column(0).slice(at))
                texts.append(text.slice(at))
        if ids:
            yield flush()

    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"kind string, block long, k long, doc {kind}, data binary, segs array<string>")


class Aligner:
    """Aligns batches of segments. A pair of ids is the number a * (size of the second vocabulary) + b."""

    def __init__(self, a_spec: str, a_bytes: list[bytes], b_model: bytes, b_bytes: list[bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_str(a_spec), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        self.bytes = (a_bytes, b_bytes)
        self.sizes = tuple(np.array([len(x) for x in side]) for side in self.bytes)
        self.digits = tuple(np.array([len(str(k)) for k in range(len(side))]) for side in self.bytes)
        self.names = {(side, end): np.array([f"{k}{end}" for k in range(len(self.bytes[side]))], object) for side, ends in ((0, ",|"), (1, (",", ";", ""))) for end in ends}

    def _ids(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each segment has."""
        n = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n

    def _spelt(self, side: int, ids: np.ndarray, n: np.ndarray, data: list[bytes]) -> np.ndarray:
        """Which segments the ids spell."""
        sizes, of = self.sizes[side][ids], np.repeat(np.arange(len(n)), n)
        ok = np.bincount(of, sizes, len(n)) == np.array([len(x) for x in data])
        ok &= np.bincount(of, sizes == 0, len(n)) == 0
        found = list(map(self.bytes[side].__getitem__, ids.tolist()))
        if ok.all() and b"".join(found) == b"".join(data):
            return ok
        ends = np.cumsum(n)
        return ok & np.array([b"".join(found[e - k : e]) == x for e, k, x in zip(ends.tolist(), n.tolist(), data, strict=True)], bool)

    def __call__(self, texts: list[str]) -> dict[str, pa.Array]:
        total = len(texts)
        (a, n_a), (b, n_b) = self._ids([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]), self._ids(self.b.encode(texts, num_threads=1))
        data = [x.encode() for x in texts]
        ok = self._spelt(0, a, n_a, data) & self._spelt(1, b, n_b, data)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = n_a * ok, n_b * ok
        of_a, of_b = np.repeat(np.arange(total), n_a), np.repeat(np.arange(total), n_b)
        # Both sides spell the same bytes, so a place where both end is a cut, and each segment's end is one.
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        cut_a, cut_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        group_a, group_b, of = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b, of_a[cut_a]
        size_a, size_b = np.bincount(group_a, minlength=len(of)), np.bincount(group_b, minlength=len(of))
        out = {"ok": pa.array(ok), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(np.bincount(of, minlength=total))}
        out["n_links"] = pa.array(np.bincount(of, size_a * size_b, total).astype(np.int64))
        out |= {"groups": self._written(total, a, b, of_a, of_b, cut_a, cut_b, group_a, group_b, np.cumsum(n_b)[ok] - 1)}
        return out | self._pairs(total, a, b, of, size_a, size_b)

    def _written(self, total, a, b, of_a, of_b, cut_a, cut_b, group_a, group_b, last_b) -> pa.Array:
        last = np.zeros(len(b), bool)
        last[last_b] = True
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        of_side = [np.where(cut_a, self.names[0, "|"][a], self.names[0, ","][a]), np.where(last, self.names[1, ""][b], np.where(cut_b, self.names[1, ";"][b], self.names[1, ","][b]))]
        whole = "".join(np.concatenate(of_side)[order].tolist()).encode()
        sizes = np.bincount(of_a, self.digits[0][a] + 1, total) + np.bincount(of_b, self.digits[1][b] + ~last, total)
        return pa.StringArray.from_buffers(total, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(whole))

    def _pairs(self, total, a, b, of, size_a, size_b) -> dict[str, pa.Array]:
        product, from_a, from_b, width = size_a * size_b, np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b, len(self.bytes[1])
        small = np.flatnonzero(product <= MAX_PRODUCT)
        group = np.repeat(small, product[small])
        place = np.arange(len(group)) - np.repeat(np.cumsum(product[small]) - product[small], product[small])
        codes = [a[from_a[group] + place // size_b[group]] * width + b[from_b[group] + place % size_b[group]]]
        owners, times = [of[group]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(product > MAX_PRODUCT):  # of long groups each pair of different ids once
            (x, n), (y, m) = (np.unique(ids[at : at + size], return_counts=True) for ids, at, size in ((a, from_a[g], size_a[g]), (b, from_b[g], size_b[g])))
            codes.append((x[:, None] * width + y).ravel())
            times.append((n[:, None] * m).ravel())
            owners.append(np.full(len(codes[-1]), of[g]))
        code, owner, time = map(np.concatenate, (codes, owners, times))
        order = np.lexsort((code, owner))
        code, owner, time = code[order], owner[order], time[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, np.int64)
        time = np.add.reduceat(time, first) if len(first) else time
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(owner[first], minlength=total))].astype(np.int32))
        return {"pairs": pa.ListArray.from_arrays(offsets, pa.array(code[first])), "times": pa.ListArray.from_arrays(offsets, pa.array(time))}


_ALIGNER: dict[str, Aligner] = {}


def align_segments(segments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each row of ``segments`` (seg) with ok (both sides spell it), counts, groups, and its linked pairs of ids with how often each is linked."""
    a_bytes, (b_model, b_bytes, _), key = byte_vocabulary(a_path), piece_model(b_path), uuid.uuid4().hex
    with open(a_path, encoding="utf-8") as f:
        a_spec = f.read()
    shared = segments.sparkSession.sparkContext.broadcast((a_spec, a_bytes, b_model, b_bytes))  # two vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ALIGNER:  # lives as long as the Python worker
            _ALIGNER.clear()
            _ALIGNER[key] = Aligner(*shared.value)
        for batch in batches:
            found = _ALIGNER[key](batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.values()], ["seg", *found])

    return segments.select("seg").mapInArrow(run, "seg string, ok boolean, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block (of) to a row a block, whose compressed columns are a small part of the rows' bytes."""
    of, held = None, []

    def result() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["of", "columns"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [*np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist(), len(blocks)] if len(blocks) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and blocks[a] != of:
                yield result()
                held = []
            of = int(blocks[a])
            held.append(batch.slice(a, b - a).select(batch.schema.names[1:]))
    if held:
        yield result()


def _to_blocks(rows: DataFrame) -> DataFrame:
    """of, columns: what :func:`_rows` reads."""
    return rows.sortWithinPartitions("of").mapInArrow(_columns, "of long, columns binary")


def _rows(packed: pa.Table) -> pa.Table | None:
    """The block's rows, in the order of k; None without any."""
    parts = [pa.ipc.open_stream(x).read_all() for x in packed.column("columns").to_pylist()]
    return pa.concat_tables(parts).combine_chunks().sort_by("k") if parts else None


def _count_pairs(docs: pa.Table, packed: pa.Table) -> pa.Table:
    """Of a block: in how many of its documents each pair is linked."""
    segments = _rows(packed)
    if segments is None:  # all its texts are empty
        return pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    rows = segments.column("pairs").combine_chunks()
    starts = rows.offsets.to_numpy()
    values = rows.values.to_numpy()[starts[0] : starts[-1]]
    codes, local = np.unique(values, return_inverse=True)
    first, size = starts[:-1] - starts[0], np.diff(starts)
    ok = segments.column("ok").to_numpy()
    counts = np.zeros(len(codes), np.int64)
    for data in docs.column("data").to_pylist():
        held = _numbers(data, len(ok))
        if len(held) > MAX_REPEATED:
            held = np.unique(held)
        if len(held) and ok[held].all():
            n = size[held]
            ends = np.cumsum(n)
            # A place that is named more than once is raised by one: values are read before any is written.
            counts[local[np.repeat(first[held] - ends + n, n) + np.arange(ends[-1])]] += 1
    seen = counts > 0
    return pa.table({"pair": pa.array(codes[seen], pa.int64()), "n": pa.array(counts[seen], pa.int64())})


def _compose(docs: pa.Table, packed: pa.Table) -> pa.Table:
    """The block's documents from the alignments of their segments."""
    segments = _rows(packed)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    if segments is None:  # all its texts are empty
        return pa.table({"doc": docs.column("doc")} | {c: pa.array([0] * len(docs), pa.int64()) for c in names} | {"groups": pa.array([""] * len(docs), pa.string())})
    columns = np.stack([segments.column(c).to_numpy() for c in names], 1)
    ok, sums, kept = segments.column("ok").to_numpy(), [], []
    for data in docs.column("data").to_pylist():
        held = _numbers(data, len(ok))
        kept.append(held if ok[held].all() else held[:0])
        sums.append(columns[kept[-1]].sum(0))
    ends = pa.array(np.r_[0, np.cumsum([len(x) for x in kept])], pa.int32())
    groups = segments.column("groups").combine_chunks().cast(pa.large_string()).take(pa.array(np.concatenate(kept)))
    texts = pc.binary_join(pa.ListArray.from_arrays(ends, groups), pa.scalar(";", pa.large_string())).cast(pa.string())
    return pa.table({"doc": docs.column("doc")} | {c: pa.array(x, pa.int64()) for c, x in zip(names, np.stack(sums).T, strict=True)} | {"groups": texts})


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: a row per row. ``a_path``: a byte-level file of the tokenizers library; ``b_path``: a piece vocabulary of sentencepiece."""
    spark = docs.sparkSession
    cutter, buckets = Cutter(safe_breaks(byte_vocabulary(a_path), piece_model(b_path)[2])), int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = len(piece_model(b_path)[1])
    blocks = _bucketed(_blocks(docs, cutter, doc_col, text_col), "blocks", buckets, "block", "kind")
    texts = blocks.where("kind = 'doc'").select("block", "doc", "data")
    listed = blocks.where("kind = 'seg'").select(F.col("block").alias("of"), F.col("k").alias("from"), F.posexplode("segs").alias("place", "seg"))
    parts = listed.select("of", (F.col("from") + F.col("place")).alias("k"), "seg").repartition(buckets, "seg")
    with shuffles_freed(spark):
        parts = _bucketed(parts, "parts", buckets, "seg")
    # Its tasks have a bucket each and keep the column, so nothing is shuffled.
    segments = _bucketed(align_segments(parts.select("seg").distinct(), a_path, b_path), "segments", buckets, "seg")

    own = parts.join(segments.select("seg", "ok", "pairs"), "seg").select("of", "k", "ok", "pairs")
    counted = texts.select("block", "data").groupBy("block").cogroup(_to_blocks(own).groupBy("of")).applyInArrow(_count_pairs, "pair long, n long")
    with shuffles_freed(spark):
        counts = materialize(counted.groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    a_id = F.floor(F.col("pair") / width).cast("long")
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # an id of the first vocabulary a row
    known = counts.join(F.broadcast(best), a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    links = segments.select("seg", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("seg", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # A pair that only texts without tokens have is in no count; those texts have zeros anyway.
    sums = links.join(known, "pair").groupBy("seg").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    with shuffles_freed(spark):
        sums = _bucketed(sums, "sums", buckets, "seg")
    scored = parts.join(segments.drop("pairs", "times"), "seg").join(sums, "seg", "left").na.fill(0, ["count_sum", "n_best"])
    own = scored.select("of", "k", "ok", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    found = texts.groupBy("block").cogroup(_to_blocks(own).groupBy("of")).applyInArrow(
        _compose, f"doc {texts.schema['doc'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )
    return found.withColumnRenamed("doc", doc_col)
