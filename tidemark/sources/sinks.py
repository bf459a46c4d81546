"""Sinks: distributed parquet, batches that are appended once, and small report tables as CSV, Markdown or LaTeX with a JSON summary."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
import uuid
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MAX_REPORT_ROWS = 10_000


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


#: Folders of an appended table: the batches' files, and a manifest for each batch that counts.
_DATA, _MANIFESTS = "data", "_manifests"


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A path of the store and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_batch(df: DataFrame, path: str, batch_id: str) -> bool:
    """Appends a batch to a table; whether it had any effect. A batch whose id was committed before has none, so a job that was cut off or run twice can send its batches again.

    The rows are staged in a folder of their own; the batch counts from the moment its manifest is there, which names that folder and which only one writer can create. Readers (:func:`read_batches`) see whole batches only, whatever a lost job has left behind.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
        raise ValueError(f"a batch id has letters, digits, dots, dashes and underscores: {batch_id!r}")
    spark = df.sparkSession
    manifest, files = _files(spark, f"{path}/{_MANIFESTS}/{batch_id}")
    if files.exists(manifest):
        return False
    folder = f"{batch_id}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{_DATA}/{folder}")
    try:
        out = files.create(manifest, False)
    except Py4JJavaError as error:
        if not files.exists(manifest):
            raise error
        staged, files = _files(spark, f"{path}/{_DATA}/{folder}")  # another writer was first
        files.delete(staged, True)
        return False
    out.write(bytearray(folder.encode()))
    out.close()
    return True


def committed_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of all batches that count: a short line a batch."""
    manifests, files = _files(spark, f"{path}/{_MANIFESTS}")
    return sorted(r["value"] for r in spark.read.text(str(manifests)).collect()) if files.exists(manifests) else []


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches, and nothing else. Raises without any."""
    folders = committed_folders(spark, path)
    if not folders:
        raise ValueError(f"no batch was committed to {path}")
    return spark.read.parquet(*[f"{path}/{_DATA}/{x}" for x in folders])


def sweep_batches(spark: SparkSession, path: str) -> int:
    """Deletes what lost jobs have staged and not committed, and tells how many folders went. Not to be run while batches are written."""
    data, files = _files(spark, f"{path}/{_DATA}")
    known, gone = set(committed_folders(spark, path)), 0
    for status in files.listStatus(data) if files.exists(data) else ():
        if status.getPath().getName() not in known:
            files.delete(status.getPath(), True)
            gone += 1
    return gone


def _cell(x: Any) -> str:
    return "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def _small(df: DataFrame) -> list[list[str]]:
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("a report table has at most 10,000 rows; write it as parquet")
    return [[_cell(x) for x in r] for r in rows]


def to_markdown(df: DataFrame) -> str:
    escape = lambda x: x.replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[escape(x) for x in r] for r in _small(df)]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines) + "\n"


# Characters that LaTeX reads as commands.
_LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def to_latex(df: DataFrame) -> str:
    escape = lambda x: "".join(_LATEX.get(c, c) for c in x)
    body = [" & ".join(map(escape, r)) + r" \\" for r in [df.columns, *_small(df)]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}", ""])


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def git_state(folder: str = ".") -> dict[str, Any] | None:
    """Commit and whether files are changed; None outside a repository."""
    try:
        run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
        return {"commit": run("rev-parse", "HEAD"), "dirty": bool(run("status", "--porcelain"))}
    except (OSError, subprocess.CalledProcessError):
        return None


def as_json(value: Any, indent: int | None = None) -> str:
    return json.dumps(value, indent=indent, sort_keys=True, default=str)


def summary(config: dict[str, Any], **facts: Any) -> dict[str, Any]:
    """The configuration, its checksum and facts about a run."""
    text = as_json(config)
    return {"config": json.loads(text), "config_sha256": hashlib.sha256(text.encode()).hexdigest(), **facts}


def write_summary(path: str, config: dict[str, Any], **facts: Any) -> dict[str, Any]:
    """A JSON summary with the configuration's checksum and the state of the repository."""
    out = summary(config, git=git_state(), **facts)
    Path(path).write_text(as_json(out, 2))
    return out
