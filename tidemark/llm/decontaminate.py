"""Benchmark decontamination with DataFrame functions alone.

The windows of all benchmark items (13 consecutive words; an item of fewer words is one window) form a hash set: a
bitmap of 16 bits a window, up to 8 MiB, that every scan task has as a constant. The scan keeps the windows whose bit
is set, so whatever the size of the benchmark only candidates leave it. A candidate is verified on the words
themselves: against the broadcast windows where these are few and short, else by a join that shuffles candidates.
Items are looked up once per document and window, after that.

Defined cases: a null or empty text has no words and is clean; a null item text has no window; an item whose id is
null still marks words but is not listed; repeated rows are judged one by one, by their texts; an empty benchmark leaves all clean.
Columns besides the id and the text are ignored by :func:`contamination` and kept by :func:`remove_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, discard, materialize, text_hash

NGRAM = 13
#: The windows are broadcast up to this number and these bytes.
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_BYTES = 1 << 18, 64 << 20
BITS_PER_WINDOW, MAX_BITS = 16, 1 << 26
#: What stands between words of a text in lower case. Splitting is linear in the text; regexp_extract_all copies it at every match.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The places in a text as it stands where a word ends and a separator starts.
WORD_END = r"(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def benchmark_windows(benchmark: DataFrame, ngram: int = NGRAM, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """gram, n (its words), h, item (as a string): one row per window of an item, repeats included."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (ngram - 1), F.lit(1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, ngram))).alias("w"))
    return windows.select("item", F.array_join("w", " ").alias("gram"), F.size("w").alias("n"), F.xxhash64("w").alias("h"))


def _probes(h: Column) -> tuple[Column, Column]:
    """Two places in the bitmap from one hash: a window that isn't there passes both in about 1 of 70 cases."""
    return h, F.shiftrightunsigned(h, 32)


def _bitmap(windows: DataFrame, n_windows: int) -> tuple[Column, int]:
    """The hash set as an array of longs, which the optimizer makes a constant of the plan, and its count of bits (a power of two). It passes the driver as text of at most 21 MB, whatever the sizes of benchmark and documents."""
    bits = 1 << max(10, (BITS_PER_WINDOW * n_windows - 1).bit_length())
    bits = min(bits, MAX_BITS)
    places = windows.select(F.explode(F.array(*[p.bitwiseAND(F.lit(bits - 1)) for p in _probes(F.col("h"))])).alias("at"))
    filled = places.groupBy(F.shiftright("at", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v"))
    dense = windows.sparkSession.range(bits // 64).join(filled, "id", "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    longs = dense.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"].cast("string")), ",").alias("x")).first()["x"]
    return F.split(F.lit(longs), ",").cast("array<bigint>"), bits


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    ngram: int = NGRAM,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_broadcast_windows: int = MAX_BROADCAST_WINDOWS,
    keep_hash: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (array), contaminated (n_hit > 0 and 20 * n_hit >= n_words), spans (array of pos and end in words), with ``keep_hash`` text_hash: a row per document."""
    named = materialize(benchmark_windows(benchmark, ngram, item_col, item_text_col), "item-windows")
    windows = materialize(named.select("gram", "n", "h").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    items_of = materialize(named.where("item IS NOT NULL").join(windows, ["gram", "n", "h"]).select("window", "item").distinct(), "window-items")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    listed = items_of.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("bytes")).first()
    few = lambda x: x["n"] <= max_broadcast_windows and x["bytes"] <= MAX_BROADCAST_BYTES
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``ngram`` values
    bitmap, bits = _bitmap(windows, size["n"]) if lengths else (None, 0)

    def candidates(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))

        def set_at(h: Column) -> Column:
            word = F.get(bitmap, F.shiftrightunsigned(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int"))
            return F.call_function("bit_get", word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

        def in_bitmap(h: Column) -> Column:
            first, second = _probes(h)
            return set_at(first) & set_at(second)

        # exists over an array of one binds the hash to a name: each window is hashed once, and no array of hashes is held.
        starts = F.filter(starts, lambda i: F.exists(F.array(F.xxhash64(F.slice(F.col("w"), i, n))), in_bitmap))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice(F.col("w"), i, n), " ").alias("gram")))

    held = ["text_hash"] * keep_hash
    none = F.array().cast("array<struct<pos:int,n:int,gram:string>>")
    rows = docs.select(F.col(doc_col).alias("doc"), *[text_hash(F.col(text_col)).alias("text_hash")] * keep_hash, words_of(F.col(text_col)).alias("w"))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc", *held, F.size("w").alias("n_words"), (F.concat(*[candidates(n) for n in lengths]) if lengths else none).alias("found"))
    scanned = materialize(rows, "scanned")
    discard(named)
    known = windows.select("gram", "n", "window")
    hits = scanned.select("uid", F.explode("found").alias("c")).select("uid", "c.*").join(F.broadcast(known) if few(size) else known, ["gram", "n"])
    hits = hits.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n")).alias("end")))).alias("spans"), F.collect_set("window").alias("windows"))
    hits = materialize(hits, "hits")
    discard(windows)
    names = hits.select("uid", F.explode("windows").alias("window")).join(F.broadcast(items_of) if few(listed) else items_of, "window")
    names = names.groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_doc = scanned.drop("found").join(hits.drop("windows"), "uid", "left").join(names, "uid", "left")
    per_doc = per_doc.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<pos:int,end:int>>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["pos"]))).alias("n")),
    )["n"]
    per_doc = per_doc.withColumn("n_hit", covered.cast("long")).withColumn("n_items", F.size("items").cast("long"))
    return per_doc.select(F.col("doc").alias(doc_col), F.col("n_words").cast("long").alias("n_words"), "n_hit", "n_items", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", *held)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", doc_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated documents (mode "documents"), or with the hit words of contaminated documents cut out of their texts (mode "spans"). The columns stay as they are."""
    bad = contamination(docs, benchmark, doc_col=doc_col, text_col=text_col, keep_hash=True, **options).where("contaminated")
    bad = bad.select(F.col(doc_col).alias("__bad"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    docs = docs.withColumn("__text", text_hash(F.col(text_col)))
    same = docs[doc_col].eqNullSafe(F.col("__bad")) & (F.col("__text") == F.col("__hash"))
    if mode == "documents":
        return docs.join(bad.select("__bad", "__hash"), same, "left_anti").drop("__text")
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    bad = bad.groupBy("__bad", "__hash").agg(F.first("__spans").alias("__spans"))
    # Piece i is word i with the separators before it; a last piece may be separators alone.
    pieces = F.split(F.col(text_col), WORD_END)
    clean = F.array_join(F.filter(pieces, lambda _, i: ~F.exists(F.col("__spans"), lambda s: (s["pos"] <= i) & (i < s["end"]))), "")
    joined = docs.join(bad, same, "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(clean)).drop("__bad", "__hash", "__text", "__spans")
