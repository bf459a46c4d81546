"""The queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import align_documents
from tidemark.llm.common import table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.langid import predict_language
from tidemark.llm.linededup import dedup_lines
from tidemark.llm.lmscore import score_documents
from tidemark.llm.media import read_features, store
from tidemark.llm.mixing import schedule
from tidemark.llm.neighbours import nearest
from tidemark.llm.pii import BASE, KINDS, find_pii
from tidemark.llm.sharding import shard_ids
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.tokencount import token_counts
from tidemark.llm.whitening import whiten


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_features(store(table(spark, sf_dir, "documents"))).withColumnRenamed("doc", "doc_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS gram, least(len(w), 13) AS n FROM bi
), ns AS (SELECT DISTINCT n FROM bw),
di AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n
), hits AS (
  SELECT di.doc_id, di.i, di.n, bw.item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM di) di JOIN bw ON bw.gram = di.gram AND bw.n = di.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in the stream that mixes the sources to their temperature weights."""
    return schedule(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i FROM t
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.i, k.line, hot.key IS NOT NULL AND hot.keeper <> k.doc_id AS gone FROM k LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_ids(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH s AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents
), cand AS (
  SELECT doc_id, n_bytes, d, h >> (60 - d) AS p FROM s, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS d)
), fits AS (
  SELECT d, p FROM cand GROUP BY d, p HAVING sum(n_bytes) <= 16777216 OR count(*) = 1
), best AS (
  SELECT doc_id, min(d) AS depth FROM cand JOIN fits USING (d, p) GROUP BY doc_id
)
SELECT s.doc_id, s.n_bytes, depth || ':' || (h >> (60 - depth)) AS shard_id, depth FROM s JOIN best USING (doc_id)
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def of(kinds: tuple[str, ...]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = {k: F.size(of((k,))).cast("long").alias(f"n_{k}") for k in KINDS}
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    more = [c for k, c in counts.items() if k not in BASE]
    return found.select("doc_id", *[counts[k] for k in BASE], F.sha2(listed(of(BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"), *more)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op10_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.uid, q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])))) AS score FROM v AS q JOIN v ON v.uid <> q.uid WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def queries() -> dict:
    return {
        "op1_progressive_jpeg": op1_progressive_jpeg,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_pfair_mixing": op3_pfair_mixing,
        "op4_line_dedup": op4_line_dedup,
        "op5_extendible_sharding": op5_extendible_sharding,
        "op6_pii": op6_pii,
        "op7_token_counts": op7_token_counts,
        "op8_lm_scores": op8_lm_scores,
        "op9_language_id": op9_language_id,
        "op10_simhash_near_dup": op10_simhash_near_dup,
        "op11_token_alignment": op11_token_alignment,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_extendible_sharding": OP5_SQL, "op13_nearest_neighbours": OP13_SQL}
