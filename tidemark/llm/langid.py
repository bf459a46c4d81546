"""Language identification with a bidirectional gated recurrent network over bytes, trained here in numpy.

Texts are cut into windows of WINDOW bytes; the states of both directions start at zero in each window, and every byte
of the text gets label probabilities from the two states at its place. A document's probabilities are their mean over
all its bytes. The weights come from backpropagation through time over a bounded sample of labelled rows (parameters
``docs_per_language`` and ``windows_per_doc``), chosen by a hash of id and text among the rows to learn from. Rows equal
in label, id and text are one row there, so null and repeated ids add no windows: a label gives at most
docs_per_language * windows_per_doc windows, 1,800 of WINDOW bytes (115 kB) with the defaults; 1,000 labels give 115 MB.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows without a label are never learned
from; without any row to learn from all is ``und``; repeated rows get one prediction each and are learned from once; an empty table gives an empty
table; other columns are ignored by :func:`predict_language`. Labels, sources and ids are no input of a prediction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import fold_column, text_hash

WINDOW, LANES, HIDDEN, PAD = 64, 4096, 8, 256
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC, MAX_LANGUAGES, PARTS = 300, 6, 1000, 64
STEPS, BATCH, RATE, SEED = 240, 256, 0.02, 7
_LETTER = regex.compile(r"\p{L}")


class ByteGru:
    """Two gated recurrent layers over bytes, one a direction, and one output layer.

    With a the byte's row of ``e`` and c = ``u`` h: z = s(a_z + c_z), r = s(a_r + c_r), n = tanh(a_n + r (c_n + ``b``)),
    and the new state is n + z (h - n). Arrays have the direction first and the lanes last.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.w = {
            "e": random.normal(0, 0.3, (2, 3 * hidden, PAD + 1)),
            "u": random.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)),
            "b": np.zeros((2, hidden, 1)),
            "v": random.normal(0, hidden**-0.5, (len(labels), 2 * hidden)),
            "c": np.zeros((len(labels), 1)),
        }
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}

    def states(self, symbols: np.ndarray, trace: list | None = None) -> np.ndarray:
        """symbols: window by lane; the states of both directions, by place: (2, hidden, window, lane)."""
        steps, lanes = symbols.shape
        d, out = self.hidden, np.empty((2, self.hidden, steps, lanes), np.float32)
        # s(x) is (1 + tanh(x / 2)) / 2: the halves go into the weights.
        half = np.ones((3 * d, 1), np.float32)
        half[: 2 * d] = 0.5
        e, u, b = self.w["e"] * half, self.w["u"] * half, self.w["b"]
        h, x = np.zeros((2, d, lanes), np.float32), np.empty((2, 3 * d, lanes), np.float32)
        c, n = np.empty_like(x), np.empty((2, d, lanes), np.float32)
        for t in range(steps):
            np.take(e[0], symbols[t], axis=1, out=x[0], mode="clip")
            np.take(e[1], symbols[steps - 1 - t], axis=1, out=x[1], mode="clip")
            np.matmul(u, h, out=c)
            gates = x[:, : 2 * d]
            gates += c[:, : 2 * d]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            inner = c[:, 2 * d :]
            inner += b
            np.multiply(gates[:, d:], inner, out=n)
            n += x[:, 2 * d :]
            np.tanh(n, out=n)
            if trace is not None:
                trace.append((h.copy(), gates.copy(), inner.copy(), n.copy()))
            h -= n
            h *= gates[:, :d]
            h += n
            out[0, :, t], out[1, :, steps - 1 - t] = h[0], h[1]
        return out

    def log_probabilities(self, symbols: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(label, window * lane) log probabilities, and the states they come from as (2 * hidden, window * lane)."""
        at = self.states(symbols, trace).reshape(2 * self.hidden, -1)
        scores = self.w["v"] @ at + self.w["c"]
        scores -= scores.max(0)
        return scores - np.log(np.exp(scores).sum(0)), at

    def window_sums(self, symbols: np.ndarray) -> np.ndarray:
        """Sums of the label probabilities over each lane's bytes: (label, lane)."""
        found = np.exp(self.log_probabilities(symbols)[0]).reshape(len(self.labels), *symbols.shape)
        found *= symbols != PAD
        return found.sum(1, dtype=np.float64)

    def gradients(self, symbols: np.ndarray, answers: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the bytes, and its gradients by backpropagation through the window's time."""
        (steps, lanes), d, trace = symbols.shape, self.hidden, []
        logs, at = self.log_probabilities(symbols, trace)
        mask = (symbols != PAD).ravel().astype(np.float32)
        mask /= mask.sum()
        wanted = np.tile(answers, steps)
        loss = -float((logs[wanted, np.arange(steps * lanes)] * mask).sum())
        error = np.exp(logs)
        error[wanted, np.arange(steps * lanes)] -= 1
        error *= mask
        g = {k: np.zeros_like(x) for k, x in self.w.items()}
        g["v"], g["c"] = error @ at.T, error.sum(1, keepdims=True)
        back = (self.w["v"].T @ error).reshape(2, d, steps, lanes)
        carry = np.zeros((2, d, lanes), np.float32)
        for t in reversed(range(steps)):
            h, gates, inner, n = trace[t]
            z, r = gates[:, :d], gates[:, d:]
            carry[0] += back[0, :, t]
            carry[1] += back[1, :, steps - 1 - t]
            dn = carry * (1 - z) * (1 - n * n)
            da = np.concatenate([carry * (h - n) * z * (1 - z), dn * inner * r * (1 - r), dn], axis=1)
            dc = da.copy()
            dc[:, 2 * d :] *= r
            g["u"] += dc @ h.transpose(0, 2, 1)
            g["b"] += dc[:, 2 * d :].sum(2, keepdims=True)
            for way, place in ((0, t), (1, steps - 1 - t)):
                for row in range(3 * d):
                    g["e"][way, row] += np.bincount(symbols[place], da[way, row], PAD + 1)
            carry = carry * z + self.w["u"].transpose(0, 2, 1) @ dc
        return loss, g

    def fit(self, symbols: np.ndarray, answers: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam over batches of windows (lane first); the losses by step."""
        random, losses = np.random.default_rng(seed), []
        first, second = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = random.integers(0, len(symbols), batch)
            loss, g = self.gradients(np.ascontiguousarray(symbols[chosen].T), answers[chosen])
            losses.append(loss)
            scale = min(1.0, 1.0 / (1e-9 + sum(float((x * x).sum()) for x in g.values()) ** 0.5))
            for k, x in self.w.items():
                first[k] += 0.1 * (scale * g[k] - first[k])
                second[k] += 0.01 * ((scale * g[k]) ** 2 - second[k])
                x -= rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all bytes of each text: (text, label). Lanes are filled across texts, LANES at a time."""
        sums = np.zeros((len(texts), len(self.labels)))
        lanes, owners, used = np.full((LANES, WINDOW), PAD, np.int16), np.zeros(LANES, np.int64), 0

        def flush() -> None:
            nonlocal used
            if used:
                found = self.window_sums(np.ascontiguousarray(lanes[:used].T))
                for label, row in enumerate(found):
                    sums[:, label] += np.bincount(owners[:used], row, len(texts))
                lanes[:used] = PAD
                used = 0

        for k, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            for start in range(0, len(data), LANES * WINDOW):
                part = data[start : start + LANES * WINDOW]
                while len(part):
                    fit = part[: (LANES - used) * WINDOW]
                    n = -(-len(fit) // WINDOW)
                    lanes[used : used + n].reshape(-1)[: len(fit)] = fit
                    owners[used : used + n] = k
                    used, part = used + n, part[len(fit) :]
                    if used == LANES:
                        flush()
        flush()
        return sums / np.maximum(1, np.array([len(x) for x in texts]))[:, None]


def training_windows(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(label, window) of the sample: per label the ``docs_per_language`` rows first by a hash of id and text, from each up to ``windows_per_doc`` windows spread over the text."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), text_hash(F.col(text_col)).alias("key"))
    keys = rows.select("doc", "lang", "key").distinct().withColumn("h", F.xxhash64("doc", "key")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    # Ranked by label and part of the hash first: the second ranking gets PARTS * docs_per_language rows of a label at most, however many tasks there are.
    for by in (("lang", "part"), ("lang",)):
        keys = keys.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc", "key"))).where(F.col("n") <= docs_per_language)
    keys = keys.select(F.col("doc").alias("id"), F.col("lang").alias("of"), F.col("key").alias("hash"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, langs, parts = [], [], []
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                if not _LETTER.search(text or ""):
                    continue
                places = range(-(-len(data) // WINDOW))
                step = max(1, len(places) // windows_per_doc)
                for k in places[zlib.crc32(str(doc).encode()) % step :: step][:windows_per_doc]:
                    keys.append(f"{zlib.crc32(f'{doc} {k}'.encode()):08x}")
                    langs.append(lang)
                    parts.append(data[k * WINDOW : (k + 1) * WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["key", "lang", "data"])

    # At most docs_per_language rows a label: a broadcast of a known size. Repeated rows are one again before they are cut.
    chosen = rows.join(F.broadcast(keys), rows["doc"].eqNullSafe(keys["id"]) & (rows["lang"] == keys["of"]) & (rows["key"] == keys["hash"]))
    chosen = chosen.groupBy("doc", "lang", "key").agg(F.max("text").alias("text")).select("doc", "text", "lang")
    return [(r["lang"], bytes(r["data"])) for r in sorted(chosen.mapInArrow(cut, "key string, lang string, data binary").collect(), key=lambda r: (r["key"], r["lang"], r["data"]))]


def train(windows: list[tuple[str, bytes]]) -> ByteGru | None:
    labels = sorted({lang for lang, _ in windows})
    if not labels:
        return None
    if len(labels) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    symbols = np.full((len(windows), WINDOW), PAD, np.int16)
    for k, (_, data) in enumerate(windows):
        symbols[k, : len(data)] = np.frombuffer(data, np.uint8)
    model = ByteGru(labels)
    model.fit(symbols, np.array([labels.index(lang) for lang, _ in windows]))
    return model


def _predicted(docs: DataFrame, source: DataFrame, kept: list[str], doc_col: str, text_col: str, lang_col: str, folds: int, held_out_fold: int) -> DataFrame:
    """kept (a struct of those columns), lang_pred, score."""
    model = train(training_windows(source.where(fold_column(F.col(doc_col), folds) != held_out_fold), doc_col=doc_col, text_col=text_col, lang_col=lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            known = [bool(_LETTER.search(x)) and model is not None for x in texts]
            best = [("und", 0.0)] * len(texts)
            places = [k for k, ok in enumerate(known) if ok]
            if places:
                for k, p in zip(places, model.document_probabilities([texts[k].encode() for k in places]), strict=True):
                    best[k] = (model.labels[p.argmax()], float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], ["kept", "lang_pred", "score"])

    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("kept"), docs[text_col].alias("text"))
    return rows.mapInArrow(predict, f"kept {rows.schema['kept'].dataType.simpleString()}, lang_pred string, score double")


def predict_language(docs: DataFrame, learn_from: DataFrame | None = None, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of ``docs``. Learns from the rows of ``learn_from`` (``docs`` itself if not given) outside the held-out fold."""
    found = _predicted(docs, docs if learn_from is None else learn_from, [doc_col], doc_col, text_col, lang_col, folds, held_out_fold)
    return found.select(F.col("kept")[doc_col].alias(doc_col), (fold_column(F.col("kept")[doc_col], folds) == held_out_fold).alias("held_out"), "lang_pred", "score")


def keep_recognised(docs: DataFrame, min_score: float, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least ``min_score``, all columns as they are."""
    found = _predicted(docs, docs, docs.columns, doc_col, text_col, lang_col, folds, held_out_fold)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("kept.*")
