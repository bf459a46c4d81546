"""Token counts of a byte-level BPE vocabulary, with a shortcut for whole tokens.

Ahead of the scan the driver proves, string by string, which entries of the vocabulary the merges lead back to one
token. A pre-token that is such an entry counts as one by a lookup; only the rest is merged, and a bounded memo keeps
what was merged. The table of proven strings goes to all executors; its size is the vocabulary's.

Defined cases: a null text is empty and has no tokens; special strings of the vocabulary file inside a text are one
token each, as the library's default has it; repeated rows are treated alike; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO, LONG_PIECE, LONG_TEXT = 400_000, 64, 1 << 22


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 letters for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))})
    return letters


class Merger:
    """The merges of a vocabulary file, over numbers: a byte is its value, a merge's result 256 plus its rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.vocabulary = [bytes(letters[c] for c in s) for s in spec["model"]["vocab"] if all(c in letters for c in s)]
        self.special = [t["content"] for t in spec["added_tokens"]]
        numbers = {bytes([b]): b for b in range(256)}
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.ranks[numbers[left] << 20 | numbers[right]] = rank
            numbers.setdefault(left + right, 256 + rank)
        self.results = [0] * len(self.ranks)
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.results[rank] = numbers[left + right]

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token: the lowest rank merges first, from the left."""
        if len(piece) > LONG_PIECE:
            return self._count_long(piece)
        ids, ranks, none = list(piece), self.ranks.get, len(self.ranks)
        while len(ids) > 1:
            found = [ranks(a << 20 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
            best = min(found)
            if best == none:
                break
            k = found.index(best)
            ids[k : k + 2] = [self.results[best]]
        return len(ids)

    def _count_long(self, piece: bytes) -> int:
        """The same with a heap of the pairs and a linked list of what is left, for pieces of any length."""
        ids: list[int | None] = list(piece)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(k: int) -> None:
            j = after[k]
            if k >= 0 and j < len(ids) and (rank := self.ranks.get(ids[k] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (rank, k, ids[k], ids[j]))

        for k in range(len(ids) - 1):
            offer(k)
        left = len(ids)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = self.results[rank], None, after[j]
            if after[k] < len(ids):
                before[after[k]] = k
            left -= 1
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return left

    def whole(self) -> dict[str, int]:
        """The vocabulary strings that encode alone as one token."""
        proven = {}
        for s in self.vocabulary:
            try:
                text = s.decode()
            except UnicodeDecodeError:
                continue
            if self.count(s) == 1:
                proven[text] = 1
        return proven


class PieceCounts(dict):
    """Tokens by pre-token: the proven ones, and a memo of merged ones that starts anew when it is full."""

    def __init__(self, proven: dict[str, int], merger: Merger):
        super().__init__(proven)
        self.proven, self.merger = proven, merger

    def __missing__(self, piece: str) -> int:
        n = self.merger.count(piece.encode())
        if len(piece) <= LONG_PIECE:
            if len(self) >= len(self.proven) + MEMO:
                self.clear()
                self.update(self.proven)
            self[piece] = n
        return n


def count_tokens(text: str, counts: PieceCounts, pieces: regex.Pattern, special: regex.Pattern | None) -> int:
    parts = special.split(text) if special else [text]
    n = len(parts) - 1
    for part in parts:
        found = pieces.findall(part) if len(part) <= LONG_TEXT else (m[0] for m in pieces.finditer(part))
        n += sum(map(counts.__getitem__, found))
    return n


_COUNTS: dict[str, PieceCounts] = {}


def _piece_counts(key: str, proven: dict[str, int], merger: Merger) -> PieceCounts:
    """The memo of a vocabulary lives as long as the Python worker."""
    if key not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[key] = PieceCounts(proven, merger)
    return _COUNTS[key]


def token_counts(docs: DataFrame, vocabulary_path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens: a row per row. ``vocabulary_path``: a byte-level BPE file of the tokenizers library, read on the driver."""
    merger = Merger(vocabulary_path)
    shared, key = docs.sparkSession.sparkContext.broadcast((merger.whole(), merger)), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _piece_counts(key, *shared.value)
        pieces = regex.compile(PATTERN)
        special = regex.compile("|".join(map(regex.escape, counts.merger.special))) if counts.merger.special else None
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([count_tokens(x, counts, pieces, special) for x in texts], pa.int64())], ["doc", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc {kind}, n_bytes long, n_tokens long").withColumnRenamed("doc", doc_col)
