"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_hash(text: Column) -> Column:
    """With the id, the key of a row whose id may be null or repeated; a null text counts as an empty one."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder; a cluster raises, since its executors couldn't see one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage is cut, and a lost executor costs no more than what it was running. Operators discard what they no longer read; what a returned frame still reads stays until :func:`clear`."""
    path = f"{work_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: Spark deletes them as each write ends. For frames that are written once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`materialize` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, re.sub(r"/[^/=]+=[^/]*$", "", folder))


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; frames that operators returned can't be read after it."""
    _delete(spark, work_dir(spark))


def fold_of(doc_id: object, folds: int) -> int:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ``null``."""
    return zlib.crc32(b"null" if doc_id is None else str(doc_id).encode()) % folds


def fold_column(doc_id: Column, folds: int) -> Column:
    """:func:`fold_of` as an expression."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(folds))
