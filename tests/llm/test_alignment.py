"""Token alignment against whole texts read by both libraries."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import alignment
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab the'sé中　\xa0 ᠎​\t\n\r\x0b\x1c \x85.;)<|>▁0́😀ﬁ"


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_vocabulary(A), alignment.piece_model(B)[1]


@pytest.fixture(scope="module")
def segmented(sides):
    data, _, pieces = alignment.piece_model(B)
    return alignment.Cutter(alignment.safe_breaks(sides[2], pieces)), sentencepiece.SentencePieceProcessor(model_proto=data)


def plain(sides, text):
    """ids and groups of a whole text, or None."""
    a_side, b_side, a_bytes, b_bytes = sides
    if not text:
        return None
    a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
    if {b"".join(a_bytes[x] for x in a), b"".join(b_bytes[x] for x in b)} != {(" " + text).encode()}:
        return None
    ends = lambda ids, data: [sum(len(data[y]) for y in ids[: k + 1]) for k in range(len(ids))]
    ends_a, ends_b = ends(a, a_bytes), ends(b, b_bytes)
    cuts = sorted(set(ends_a) & set(ends_b))
    group = lambda ids, at: [[x for x, e in zip(ids, at, strict=True) if lo < e <= hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]
    return a, b, list(zip(group(a, ends_a), group(b, ends_b), strict=True))


def brute(sides, rows):
    found = [(doc, plain(sides, text)) for doc, text in rows]
    counts = Counter()
    for _, x in found:
        counts.update({(p, q) for a, b in x[2] for p in a for q in b} if x else ())
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for doc, x in found:
        links = [(p, q) for a, b in x[2] for p in a for q in b] if x else []
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in x[2]) if x else ""
        out.append((doc, len(x[0]) if x else 0, len(x[1]) if x else 0, len(x[2]) if x else 0, len(links), sum(counts[i] == most[i[0]] for i in links), sum(counts[i] for i in links), text))
    return out


def test_breaks(sides):
    breaks = alignment.safe_breaks(sides[2], alignment.piece_model(B)[2])
    assert " " in breaks and "\n" in breaks
    assert "\r" not in breaks  # a piece has it behind a semicolon
    assert "\n" not in alignment.safe_breaks([b"a\n"], []) and " " not in alignment.safe_breaks([], ["a b"])


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=ALPHABET, min_size=1, max_size=40))
def test_segments_make_the_whole(sides, segmented, text):
    a_side, b_side = sides[:2]
    cutter, own = segmented
    parts = cutter(" " + text)
    assert "".join(parts) == " " + text
    assert [x for s in parts for x in a_side.encode(s, add_special_tokens=False).ids] == a_side.encode(" " + text, add_special_tokens=False).ids
    assert [x for s in parts for x in own.encode(s)] == b_side.encode(text)


def test_documents(spark, make, sides, monkeypatch):
    random.seed(5)
    words = ["the", "tokenizer's", "Größe", "中文字", "<|endoftext|>", "<s>", "x;\r", "\t", "\n\n", "  ", "0123456789", "naïve", "😀", "ab" * 20, "\xa0"]
    texts = ["".join(random.choice(words) + random.choice(["", " ", "\n"]) for _ in range(random.randint(1, 30))) for _ in range(60)]
    texts += [None, "", " ", "\n", "a▁b the", "the the the", texts[0], texts[0], "word " * 3000 + "x" * 5000, "\x00a"]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(3, "again")]
    docs = make(rows).repartition(3)
    got = alignment.align_documents(docs, A, B).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(sides, rows)))
    # Small blocks: many of them, and texts with more segments than a block may have.
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    again = alignment.align_documents(docs, A, B).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_large_block(spark, make, sides):
    """A text with more distinct segments than two bytes can number."""
    rows = [(1, " ".join(map(str, range(70_000)))), (2, "7 8"), (3, None)]
    got = sorted(tuple(r)[:7] for r in alignment.align_documents(make(rows).coalesce(1), A, B).collect())
    a, b = (x.encode(rows[0][1] if x is sides[1] else " " + rows[0][1]) for x in sides[:2])
    assert got[0][:3] == (1, len(a.ids), len(b)) and got[2] == (3, 0, 0, 0, 0, 0, 0) and got[1][1] == 2


def test_block_rows(make, segmented):
    """A block's segments leave it as lists, not a row each."""
    docs = make([(1, " ".join(f"w{k}" for k in range(3000))), (2, None), (3, ""), (4, "w2999 w1\n w1")]).coalesce(1)
    rows = alignment._blocks(docs, segmented[0], "doc_id", "text").collect()
    lists = sorted((r for r in rows if r.kind == "seg"), key=lambda r: r.k)
    assert [r.k for r in lists] == [0, 1024, 2048] and len(rows) == 7
    distinct = [s for r in lists for s in r.segs]
    data = {r.doc: [distinct[k] for k in alignment._numbers(bytes(r.data), len(distinct)).tolist()] for r in rows if r.kind == "doc"}
    assert data == {1: distinct[:3000], 2: [], 3: [], 4: [" w2999", " w1", "\n w1"]}


@pytest.mark.parametrize("most", [0, 1 << 16])
def test_counts_of_repeated_segments(monkeypatch, most):
    monkeypatch.setattr(alignment, "MAX_REPEATED", most)
    rows = pa.RecordBatch.from_pydict({"of": [5] * 4, "k": [1, 0, 2, 3], "ok": [True, True, True, False], "pairs": [[7, 9], [7], [3], []]})
    packed = pa.Table.from_batches(alignment._columns(iter([rows])))
    docs = pa.table({"data": [alignment._packed(np.array(x, np.uint32), 4) for x in ([0, 1, 0, 1], [2], [0, 0], [], [1, 3])]})
    assert sorted(alignment._count_pairs(docs, packed).to_pylist(), key=str) == [{"pair": 3, "n": 1}, {"pair": 7, "n": 2}, {"pair": 9, "n": 1}]


def test_empty_table(make):
    assert alignment.align_documents(make([]), A, B).collect() == []
