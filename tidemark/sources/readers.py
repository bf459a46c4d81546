"""Sources: projected scans, schemas with aliases, file inspection in tasks."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the raw files.
MARKET_COLUMNS = ["ticker", "event_ticker", "market_type", "title", "yes_sub_title", "no_sub_title", "status", "yes_bid", "yes_ask", "no_bid", "no_ask", "last_price", "volume", "volume_24h", "open_interest", "result", "created_time", "open_time", "close_time", "_fetched_at"]
TRADE_COLUMNS = ["trade_id", "ticker", "count", "yes_price", "no_price", "taker_side", "created_time", "_fetched_at"]
QUOTE_COLUMNS = ["ticker", "yes_bid", "yes_ask", "no_bid", "no_ask", "_fetched_at"]


def read_columns_of(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """A parquet directory's columns; the scan reads no others. Raises if one is missing."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def read_markets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_columns_of(spark, path, MARKET_COLUMNS)


def read_trades(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_columns_of(spark, path, TRADE_COLUMNS)


def read_quotes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_columns_of(spark, path, QUOTE_COLUMNS)


@dataclass(frozen=True)
class Field:
    name: str
    aliases: tuple[str, ...] = ()
    required: bool = True


@dataclass(frozen=True)
class SchemaCheck:
    resolved: dict[str, str]
    missing: list[str]
    extra: list[str]

    @property
    def ok(self) -> bool:
        return not self.missing


TRADE_FIELDS = (Field("trade_id", ("id",)), Field("contract_id", ("ticker", "market_ticker")), Field("source_ts", ("created_time", "timestamp")), Field("yes_price", ("price",)), Field("volume", ("count", "size"), False))


def resolve_columns(columns: list[str], fields: tuple[Field, ...]) -> SchemaCheck:
    """The actual column of each field: its name or its first alias that is there, whatever the case; what is missing and what is left over."""
    there = {c.lower(): c for c in reversed(columns)}
    resolved = {}
    for f in fields:
        for name in (f.name, *f.aliases):
            if name.lower() in there:
                resolved[f.name] = there[name.lower()]
                break
    return SchemaCheck(resolved, [f.name for f in fields if f.required and f.name not in resolved], sorted(set(columns) - set(resolved.values())))


def canonical(df: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    check = resolve_columns(df.columns, fields)
    if not check.ok:
        raise ValueError(f"missing columns: {check.missing}")
    return df.select(*[F.col(f"`{actual}`").alias(name) for name, actual in check.resolved.items()])


def sniff_columns(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV, TSV, JSON, JSON-lines or parquet file, by its suffix. Only a JSON document, which has no header, is read as a whole; of JSON lines the first one counts."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path).columns
    if kind in ("jsonl", "ndjson"):
        first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).select(F.json_object_keys("value").alias("k")).first()
        return list(first["k"] or []) if first else []
    if kind == "json":
        return spark.read.option("multiLine", True).json(path).columns
    if kind == "parquet":
        return spark.read.parquet(path).columns
    raise ValueError(f"no reader for {path}")


#: Bytes that a task holds of a file at a time.
PIECE_BYTES = 8 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (``file:/a b``), and the path there."""
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"{scheme}://{quote('/' + rest.lstrip('/'))}" if not rest.startswith("//") else quote(path, safe=":/"))


def _digest(files: fs.FileSystem, path: str) -> str:
    h = hashlib.sha256()
    with files.open_input_stream(path) as stream:
        while piece := stream.read(PIECE_BYTES):
            h.update(piece)
    return h.hexdigest()


def _header(files: fs.FileSystem, path: str) -> tuple[list[str] | None, int | None]:
    """Columns, and the rows of a parquet file, from a footer or a first line; a JSON document has no header and is parsed."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        with files.open_input_file(path) as f:
            footer = parquet.ParquetFile(f)
            return footer.schema_arrow.names, footer.metadata.num_rows
    if kind not in ("csv", "tsv", "jsonl", "ndjson", "json"):
        return None, None
    with files.open_input_stream(path, compression=None) as stream, io.TextIOWrapper(stream, encoding="utf-8", newline="") as lines:
        if kind in ("csv", "tsv"):
            return next(csv.reader(lines, delimiter="\t" if kind == "tsv" else ","), []), None
        value = json.load(lines) if kind == "json" else json.loads(next((x for x in lines if x.strip()), "{}"))
    if isinstance(value, list):
        value = {k: None for row in value if isinstance(row, dict) for k in row}
    return (list(value) if isinstance(value, dict) else None), None


def inspect_files(spark: SparkSession, path: str, pattern: str = "*", fields: tuple[Field, ...] = ()) -> DataFrame:
    """name, bytes, sha256, rows (of parquet), columns, missing (of ``fields``), entry (the file or folder right below ``path`` that it belongs to) of each file below a folder.

    Tasks do all of it: a task streams a file through its digest in pieces, whatever its size, and reads its footer or first line. A file without a reader, or one that can't be read, has no columns. Spark doesn't list empty files. Stores that only the JVM can open (see :mod:`pyarrow.fs` for those that Python can) give sizes alone.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for where, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = columns = rows = None
                try:
                    files, inner = _opened(where)
                    digest = _digest(files, inner)
                    columns, rows = _header(files, inner)
                except (OSError, ValueError):  # it stays in the list without what couldn't be read
                    pass
                missing = None if columns is None else resolve_columns(columns, fields).missing
                name = where.rsplit("/", 1)[-1]
                out.append((name, size, digest, rows, columns, missing, where[len(root) :].split("/", 1)[0] if where.startswith(root) else name))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["name", "bytes", "sha256", "rows", "columns", "missing", "entry"])

    spread = listed.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(inspect, "name string, bytes long, sha256 string, rows long, columns array<string>, missing array<string>, entry string")


def schema_groups(spark: SparkSession, paths: list[str]) -> tuple[dict[tuple[str, ...], list[str]], list[str]]:
    """Files by their tuple of columns, and those that can't be read."""
    groups: dict[tuple[str, ...], list[str]] = {}
    unreadable = []
    for path in paths:
        try:
            groups.setdefault(tuple(spark.read.parquet(path).columns), []).append(path)
        except Exception:  # noqa: BLE001  whatever the reader has against a file, it belongs in the audit
            unreadable.append(path)
    return groups, unreadable


def count_rows(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """name, rows of tables: counts that come from the files' footers."""
    out = None
    for name in names:
        one = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
