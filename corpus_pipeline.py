"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize, table
from tidemark.llm.decontaminate import remove_contaminated
from tidemark.llm.langid import keep_recognised
from tidemark.llm.mixing import mix, stream_order
from tidemark.llm.sharding import assign_shards
from tidemark.llm.simhash import keep_one_per_group

#: Below this probability no language is taken as recognised.
MIN_LANGUAGE_SCORE = 0.35


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters, and those that fit no language, go."""
    return keep_recognised(docs, MIN_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return keep_one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the table benchmark."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the stream that keeps the sources' temperature weights; a source that has run out leaves the rotation."""
    return mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard_id, each shard within its byte limit and its rows in the order of the mixed stream."""
    return assign_shards(docs, order=stream_order(docs))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: The recurrent network's predictions have no SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, name)
    return docs
