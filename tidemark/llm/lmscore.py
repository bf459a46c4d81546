"""Scores of whole documents under a word frequency model and a gated recurrent language model.

Everything is gathered from all training documents: word counts (a shuffle), and the recurrent model's weights, which
come from one pass over every training token in ROUNDS rounds. The documents are dealt to rounds and workers by a hash
of id and tokens. How many workers there are follows from the training tokens alone (one for ROUND_TOKENS of them a
round), so each makes as many steps in a round at any size of the corpus, and the model is the same however the input
is partitioned. In a round every worker learns from its documents, in the order of their hashes and from the same
weights; the workers' weights are averaged by their tokens in Spark, and the average change, with MOMENTUM of the last
round's, is the next round's start. Documents equal in id and text share a worker, which streams them. The most
frequent words (HEAD at most) go to all executors; all rarer words meet their counts in a shuffled join.

A word outside the recurrent model's vocabulary has the probability of "other" in its place times its smoothed share
of all such words, so that both scores are sums over the same tokens.

Defined cases: a null or empty text is its end token alone; a word that was never counted has count 0; without any
training document all counts are 0; repeated rows are scored one by one, and each is learned from; a null id counts as
the text ``null`` for the fold; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import neural_lm
from tidemark.llm.common import fold_column, materialize
from tidemark.llm.simhash import word_chunks

HEAD, ROUNDS, ROUND_TOKENS, MOMENTUM = 1 << 17, 8, 1 << 20, 0.3
#: A task hands on its counts whenever it holds so many words.
COUNTER_WORDS = 200_000
#: Training texts that a task puts side by side, in tokens.
STREAM_TOKENS = 1 << 20
BLOCK, FAN_IN = 4096, 256


def _head(counts: DataFrame, head_words: int) -> tuple[list[tuple[bytes, int]], int]:
    """The words with the highest counts, most frequent first, and the count from which on words are among them. The count is the least on a scale of eight steps a doubling that lets in at most ``head_words``, so all tasks together send no more to the driver."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = sorted(((r["s"], r["k"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect()), reverse=True)  # at most 8 * 63 rows
    total, least = 0, 1 << 62
    for _, k, n in sizes:
        if total + k > head_words:
            break
        total, least = total + k, n
    rows = [(bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= least).collect()]
    return sorted(rows, key=lambda r: (-r[1], r[0])), least


def _words(text: str | None) -> Iterator[list[bytes]]:
    return word_chunks((text or "").encode().lower())


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n: over the column text of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in _words(text):
                    counter.update(words)
                if len(counter) >= COUNTER_WORDS:
                    yield rows()
                    counter.clear()
        yield rows()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _encode(docs: DataFrame, head: dict[bytes, int], logs: np.ndarray, end_log: float, end_known: bool) -> DataFrame:
    """Each row of docs (uid, doc, text) with its model numbers (16-bit, as bytes), what its head words add to the scores, and its rarer words."""
    shared = docs.sparkSession.sparkContext.broadcast((head, logs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs = shared.value
        find, size = head.get, neural_lm.VOCABULARY
        for batch in batches:
            tokens, n_tokens, n_known, n_other, base, other, rare, rare_n = ([] for _ in range(8))
            for text in batch.column(2).to_pylist():
                numbers, tail = [], Counter()
                sums, known, others = np.array([end_log, 0.0]), int(end_known), 0
                for words in _words(text):
                    ranks = np.array([find(w, -1) for w in words], np.int64)
                    tail.update([words[k] for k in np.flatnonzero(ranks < 0)])
                    in_head, in_model = ranks >= 0, (ranks >= 0) & (ranks < size)
                    sums += logs[ranks[in_head]].sum(), logs[ranks[in_head & ~in_model]].sum()
                    known += int(in_head.sum())
                    others += int((~in_model).sum())
                    numbers.append(np.where(in_model, ranks + 2, neural_lm.OTHER).astype(np.uint16))
                numbers.append(np.array([neural_lm.END], np.uint16))
                whole = np.concatenate(numbers)
                tokens.append(whole.tobytes())
                n_tokens.append(len(whole))
                n_known.append(known)
                n_other.append(others)
                base.append(sums[0])
                other.append(sums[1])
                rare.append(list(tail))
                rare_n.append(list(tail.values()))
            columns = [batch.column(0), batch.column(1), pa.array(tokens, pa.binary()), *(pa.array(x, pa.int64()) for x in (n_tokens, n_known, n_other)), pa.array(base, pa.float64()), pa.array(other, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc", "tokens", "n_tokens", "n_known", "n_other", "base", "other", "rare", "rare_n"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("uid", "doc", "text").mapInArrow(encode, f"uid long, doc {kind}, tokens binary, n_tokens long, n_known long, n_other long, base double, other double, rare array<binary>, rare_n array<long>")


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16)


def _train_round(texts: DataFrame, weights: dict[str, np.ndarray], workers: int, rate: float) -> dict[str, np.ndarray]:
    """The weights averaged over the workers, each trained from ``weights`` on its own rows of ``texts`` (worker, h, tokens)."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, stream, held, learned, mine = None, [], 0, 0, None

        def learn() -> None:
            nonlocal stream, held, learned
            if held:
                trainer.learn(np.concatenate(stream))
                learned, stream, held = learned + held, [], 0

        def result() -> Iterator[pa.RecordBatch]:
            learn()
            if learned:
                values = neural_lm.flat(trainer.w)
                blocks = [values[k : k + BLOCK] for k in range(0, len(values), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(blocks)), pa.int32()), pa.array([mine] * len(blocks), pa.int32()), pa.array([float(learned)] * len(blocks)), pa.array(blocks, pa.list_(pa.float32()))],
                    ["block", "model", "weight", "x"],
                )

        for batch in batches:
            for worker, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if worker != mine:
                    yield from result()
                    trainer, mine, learned = neural_lm.Trainer({k: x.copy() for k, x in shared.value.items()}, rate), worker, 0
                stream.append(_numbers(data))
                held += len(stream[-1])
                if held >= STREAM_TOKENS:
                    learn()
        yield from result()

    def average(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("model")  # sums of the same order each time
        w = table.column("weight").to_numpy()
        x = np.stack([np.asarray(v, np.float64) for v in table.column("x").to_pylist()])
        mean = (w[:, None] * x).sum(0) / w.sum()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([key[1].as_py()], pa.int32()), "weight": pa.array([float(w.sum())]), "x": pa.array([mean], pa.list_(pa.float32()))})

    schema = "block int, model int, weight double, x array<float>"
    dealt = texts.repartition(workers, "worker").sortWithinPartitions("worker", "h", "tokens")
    models = dealt.select("worker", "tokens").mapInArrow(train, schema)
    while workers > 1:  # at most FAN_IN models meet in a task, however many there are
        models = models.withColumn("group", F.expr(f"cast(model div {FAN_IN} as int)")).groupBy("block", "group").applyInArrow(average, schema)
        workers = -(-workers // FAN_IN)
    found = sorted(models.select("block", "x").collect())  # one model's weights
    return neural_lm.unflat(np.concatenate([np.asarray(r["x"]) for r in found]), weights) if found else weights


def _train(texts: DataFrame, weights: dict[str, np.ndarray], tokens: int, rounds: int, rate: float, momentum: float = MOMENTUM, round_tokens: int = ROUND_TOKENS) -> dict[str, np.ndarray]:
    """The weights after ``rounds`` rounds over ``texts`` (doc, tokens), which hold so many tokens."""
    workers = max(1, math.ceil(tokens / (rounds * round_tokens)))
    h = F.xxhash64("doc", "tokens")
    dealt = texts.select("tokens", h.alias("h"), F.pmod(h, F.lit(rounds)).alias("round"), F.pmod(F.floor(h / rounds), F.lit(workers)).cast("int").alias("worker"))
    moved = {k: np.zeros_like(x) for k, x in weights.items()}
    for k in range(rounds):
        found = _train_round(dealt.where(F.col("round") == k).drop("round"), weights, workers, rate * (1 - k / rounds))
        moved = {name: (found[name] - x) + momentum * moved[name] for name, x in weights.items()}
        weights = {name: x + moved[name] for name, x in weights.items()}
    return weights


def _recurrent_scores(encoded: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = neural_lm.score(shared.value, [_numbers(x) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found / math.log(10))], ["uid", "recurrent"])

    return encoded.select("uid", "tokens").mapInArrow(run, "uid long, recurrent double")


def score_documents(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out_fold: int = 1, head_words: int = HEAD, rounds: int = ROUNDS, rate: float = neural_lm.RATE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts, a row per row."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    held: Column = fold_column(F.col("doc"), folds) == held_out_fold
    n_ends = rows.where(~held).count()
    counts = materialize(count_words(rows.where(~held)), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_types = sums["n"] + n_ends, sums["v"] + (n_ends > 0)
    top, least = _head(counts, head_words)
    head, head_n = {w: k for k, (w, _) in enumerate(top)}, np.array([n for _, n in top], np.float64)
    logs = np.log10(head_n + 0.5)

    encoded = materialize(_encode(rows, head, logs, math.log10(n_ends + 0.5), n_ends > 0), "encoded")

    model_n = head_n[: neural_lm.VOCABULARY]
    n_other, other_types = sums["n"] - model_n.sum(), sums["v"] - len(model_n)
    weights = neural_lm.initial_weights(model_n, n_ends, n_other)
    weights = _train(encoded.where(~held).select("doc", "tokens"), weights, int(n_train), rounds, rate)
    recurrent = _recurrent_scores(encoded, weights)

    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("uid", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("k"))
    tail = counts.where(F.col("n") < least).withColumnRenamed("n", "c")
    found = rare.join(tail, "word", "left").select("uid", "k", F.coalesce("c", F.lit(0)).alias("c"))
    rare_sums = found.groupBy("uid").agg(F.sum(F.col("k") * F.log10(F.col("c") + 0.5)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"))

    joined = encoded.select("uid", "doc", "n_tokens", "n_known", "n_other", "base", "other").join(recurrent, "uid").join(rare_sums, "uid", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    total, rest = math.log10(n_train + 0.5 * (n_types + 1)), math.log10(n_other + 0.5 * (other_types + 1))
    return joined.select(
        F.col("doc").alias(doc_col),
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("recurrent") + F.col("other") + rare_log - F.col("n_other") * F.lit(rest)).alias("score"),
    )
