"""Language ID and LM scoring: gradients, brute-force versions, held-out quality, edge cases."""

import collections
import math
import zlib

import numpy as np
import pytest
from tidemark.llm import langid, lmscore, neural_lm
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def numeric_check(weights, loss, gradients):
    for k, x in weights.items():
        at = np.unravel_index(np.abs(gradients[k]).argmax(), x.shape)
        old, step = x[at], 1e-2
        x[at] = old + step
        up = loss()
        x[at] = old - step
        slope, x[at] = (up - loss()) / (2 * step), old
        assert slope == pytest.approx(gradients[k][at], rel=2e-2, abs=1e-5), k


def test_byte_gru_gradients():
    rng, model = np.random.default_rng(0), langid.ByteGru(["a", "b", "c"], 4)
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    symbols, answers = rng.integers(0, 257, (5, 6)).astype(np.int16), rng.integers(0, 3, 6)
    numeric_check(model.w, lambda: model.gradients(symbols, answers)[0], model.gradients(symbols, answers)[1])


def test_document_probabilities_cover_whole_texts():
    model, rng = langid.ByteGru(["a", "b"], 4), np.random.default_rng(1)
    texts = [b"", b"x", rng.bytes(64), rng.bytes(65), rng.bytes(langid.WINDOW * langid.LANES + 100), rng.bytes(1000)]
    got = model.document_probabilities(texts)
    for text, p in zip(texts, got, strict=True):
        total = np.zeros(2)
        for k in range(0, len(text), langid.WINDOW):
            part = np.full((langid.WINDOW, 1), langid.PAD, np.int16)
            part[: len(text[k : k + langid.WINDOW]), 0] = np.frombuffer(text[k : k + langid.WINDOW], np.uint8)
            total += model.window_sums(part)[:, 0]
        assert p == pytest.approx(total / max(1, len(text)), abs=1e-4)


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict_language(docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(truth)


def test_language_edges(make):
    rows = [(k, "the and that with this " * 4, "en") for k in range(8)] + [(k, "der und das mit dies " * 4, "de") for k in range(8, 16)]
    rows += [(20, None, "en"), (21, "", "de"), (22, "12 34 -- ²½", "en"), (23, "the and that " * 3000, None), (None, "der und das", None), (0, "the and", "en")]
    docs = make(rows)
    got = langid.predict_language(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (20, 21, 22))
    assert by[23].lang_pred == "en" and by[None].lang_pred in ("en", "de")
    kept = langid.keep_recognised(docs, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    unlabelled = make([(1, "some text", None), (2, None, None)])
    assert [r.lang_pred for r in langid.predict_language(unlabelled).collect()] == ["und", "und"]
    assert langid.predict_language(make([])).count() == 0


def test_recurrent_lm_gradients():
    rng = np.random.default_rng(0)
    w = {k: x.astype(np.float64) for k, x in neural_lm.initial_weights(np.arange(neural_lm.VOCABULARY, 0, -1), 50, 100).items()}
    before, targets, weight, h = rng.integers(0, 40, (5, 4)), rng.integers(0, 300, (5, 4)), np.ones((5, 4)), rng.normal(0, 1, (neural_lm.HIDDEN, 4))
    numeric_check(w, lambda: neural_lm.gradients(w, h, before, targets, weight)[0], neural_lm.gradients(w, h, before, targets, weight)[1])


def test_lm_probabilities_sum_to_one():
    w = neural_lm.initial_weights(np.arange(100, 0, -1), 5, 7)
    h = np.random.default_rng(0).normal(0, 1, (neural_lm.HIDDEN, 1)).astype(np.float32)
    every = np.arange(neural_lm.VOCABULARY + 2)
    assert np.exp(neural_lm.log_probabilities(w, np.repeat(h, len(every), 1), every)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_scores_carry_state_over_whole_texts():
    rng, w = np.random.default_rng(0), neural_lm.initial_weights(np.arange(300, 0, -1), 5, 7)
    texts = [np.r_[rng.integers(1, 300, n), 0].astype(np.uint16) for n in (0, 1, 5, 5, 700, 40)]
    got = neural_lm.score(w, texts, lanes=4, flush=64)
    for text, value in zip(texts, got, strict=True):
        h, before, total = np.zeros((neural_lm.HIDDEN, 1), np.float32), np.zeros(1, np.int64), 0.0
        for token in text:
            h = neural_lm._step(w, h, before)[0]
            before = np.array([token], np.int64)
            total += float(neural_lm.log_probabilities(w, h, before)[0])
        assert value == pytest.approx(total, rel=1e-4)


def brute_base(rows):
    held = [zlib.crc32(("null" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    words = [(r[1] or "").encode().lower().split() for r in rows]
    counts = collections.Counter()
    for w, h in zip(words, held, strict=True):
        if not h:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    return [(h, len(w) + 1, sum(x in counts for x in [*w, None]), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])) for w, h in zip(words, held, strict=True)]


@pytest.mark.parametrize("head", [1 << 17, 50, 3])
def test_base_scores(make, head):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(f"W{x}" for x in rng.zipf(1.4, 60))) for k in range(40)] + [(100, None), (101, ""), (None, "null id"), (3, "again W1"), (3, "again W1"), (102, "W1 " * 9000)]
    got = lmscore.score_documents(make(rows), head_words=head, rounds=2).collect()
    want = brute_base(rows)
    pack = lambda rows: sorted((str(i), h, n, k, t, round(b, 6)) for i, h, n, k, t, b in rows)
    assert pack((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == pack((row[0], *x) for row, x in zip(rows, want, strict=True))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_without_training_documents(make):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    got = lmscore.score_documents(make([(held, "a b")])).collect()
    assert (got[0].train_tokens, got[0].n_tokens, got[0].n_known, got[0].base_score) == (0, 3, 0, 0.0) and math.isfinite(got[0].score)
    assert lmscore.score_documents(make([])).count() == 0


def test_lm_beats_the_frequencies_on_any_partitions(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    monkeypatch.setattr(lmscore, "ROUND_TOKENS", 1 << 20)
    scores = []
    for n in (1, 8, 100):
        got = lmscore.score_documents(docs.repartition(n)).collect()
        held = [r for r in got if r.held_out]
        tokens = sum(r.n_tokens for r in held)
        assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.05
        scores.append({r.doc_id: r.score for r in got})
    for other in scores[1:]:
        assert all(other[k] == pytest.approx(v, rel=1e-3) for k, v in scores[0].items())


def test_lm_learns_with_many_workers(spark):
    """Averaged workers, and more text, make the model better."""
    rng = np.random.default_rng(2)
    chain = rng.permutation(40)  # each word tells the next
    texts = []
    for k in range(600):
        words = [int(rng.integers(40))]
        for _ in range(99):
            words.append(int(chain[words[-1]]) if rng.random() < 0.9 else int(rng.integers(40)))
        texts.append((k, np.array([2 + w for w in words] + [0], np.uint16).tobytes()))
    rows = spark.createDataFrame(texts, "doc long, tokens binary").repartition(5)
    start = neural_lm.initial_weights(np.full(40, 1500.0), 600, 1)
    tried = [np.frombuffer(t, np.uint16) for _, t in texts[:60]]
    loss = lambda w: -neural_lm.score(w, tried).mean() / 101
    few = loss(lmscore._train(rows.where("doc < 150"), start, 15_150, 4, 0.03, round_tokens=1000))
    many = loss(lmscore._train(rows, start, 60_600, 4, 0.03, round_tokens=4000))
    assert many < few < loss(start) - 0.2


def test_sample_is_bounded_for_null_and_repeated_ids(spark):
    one = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "repeat('the and that with ', 200) AS text", "'en' AS lang")
    assert len(langid.training_windows(one)) <= langid.WINDOWS_PER_DOC
    many = spark.range(3000).selectExpr("CAST(IF(id % 2 = 0, NULL, 7) AS LONG) AS doc_id", "repeat(concat('word', id, ' '), 200) AS text", "'en' AS lang")
    found = langid.training_windows(many)
    assert len(found) <= langid.DOCS_PER_LANGUAGE * langid.WINDOWS_PER_DOC and len({w for _, w in found}) > 1000
