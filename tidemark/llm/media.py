"""Media columns: progressive JPEG streams written, read back and turned into tensors, as Spark jobs.

A stored payload is a text's UTF-8 bytes, filled up with spaces to a positive multiple of 192. A progressive JPEG's
own unit is the quantised coefficient, which it keeps exactly, so each byte is one coefficient; pixels would come back
rounded. Payloads above ``pjpeg.FRAME_BYTES`` are several images in one stream, and all work goes by chunks of about
CHUNK_BYTES, so memory doesn't follow the length of a text.

Defined cases: null and empty texts are 192 spaces; a null stream has null results in :func:`decode_tensors`; repeated
rows are stored alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import pjpeg
from tidemark.llm.common import materialize

UNIT, CHUNK_BYTES = 192, 4 << 20


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT))


def _chunks(items: list, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of items (with a length) that together stay within the limit, one item at least."""
    start, held = 0, 0
    for k, x in enumerate(items):
        if k > start and held + len(x) > limit:
            yield start, k
            start, held = k, 0
        held += len(x)
    if start < len(items):
        yield start, len(items)


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    frames = [(k, np.frombuffer(p, np.uint8, min(pjpeg.FRAME_BYTES, len(p) - at), at)) for k, p in enumerate(payloads) for at in range(0, len(p), pjpeg.FRAME_BYTES)]
    streams: list[list[bytes]] = [[] for _ in payloads]
    for a, b in _chunks([f for _, f in frames], CHUNK_BYTES):
        for (k, _), image in zip(frames[a:b], pjpeg.encode([f for _, f in frames[a:b]]), strict=True):
            streams[k].append(image)
    return [b"".join(x) for x in streams]


def decoded_frames(streams: list[bytes]) -> Iterator[tuple[int, pjpeg.Image]]:
    """(stream, image) in order."""
    for a, b in _chunks(streams, CHUNK_BYTES):
        for k, images in enumerate(pjpeg.decode(streams[a:b]), a):
            yield from ((k, image) for image in images)


def store(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, n_bytes, media (the stream): written to the shared folder and read from there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = pa.array([len((x or "").encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(encode_streams([padded(x) for x in texts]), pa.binary())], ["doc", "n_bytes", "media"])

    kind = docs.schema[doc_col].dataType.simpleString()
    rows = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(encode, f"doc {kind}, n_bytes long, media binary")
    return materialize(rows, "media")


def decode_tensors(media: DataFrame, key_col: str = "doc", media_col: str = "media") -> DataFrame:
    """key, frame, height, width, rgb (row-major bytes): a row per image of each stream, at full resolution, of any progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            there = [k for k, x in enumerate(streams) if x is not None]
            frame, before = 0, -1
            for k, image in decoded_frames([bytes(streams[k]) for k in there]):
                frame, before = (frame + 1 if k == before else 0), k
                yield _tensor_row(batch.schema.field(0).type, keys[there[k]], frame, pjpeg.to_rgb(image))
            for k in sorted(set(range(len(keys))) - set(there)):
                yield _tensor_row(batch.schema.field(0).type, keys[k], None, None)

    kind = media.schema[key_col].dataType.simpleString()
    return media.select(F.col(key_col).alias("key"), F.col(media_col).alias("media")).mapInArrow(run, f"key {kind}, frame int, height int, width int, rgb binary")


def _tensor_row(kind: pa.DataType, key: object, frame: int | None, rgb: np.ndarray | None) -> pa.RecordBatch:
    shape = (None, None) if rgb is None else rgb.shape[:2]
    columns = [pa.array([key], kind), *(pa.array([x], pa.int32()) for x in (frame, *shape)), pa.array([None if rgb is None else rgb.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "frame", "height", "width", "rgb"])


_TENSORS = pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]))


def read_features(media: DataFrame) -> DataFrame:
    """doc, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tensors: of the stored streams (columns as :func:`store` gives them).

    tensors has each image's height, width and full-resolution RGB (row-major bytes) and is the media column that the caller stores; the feature is each tensor's size, mean colour and checksum. Rows leave in batches of about CHUNK_BYTES of tensors.
    """
    names = ["doc", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _TENSORS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(2).to_pylist()
            start, held, rows = 0, 0, []
            for k, images in groupby(decoded_frames(streams), key=itemgetter(0)):
                rows.append(_features(streams[k], [image for _, image in images]))
                held += sum(len(x["rgb"]) for x in rows[-1][-1])
                if held > CHUNK_BYTES or k + 1 == len(streams):
                    made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(rows)) for c in (0, 1)), *made], names)
                    start, held, rows = k + 1, 0, []

    kind = media.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors array<struct<height:int,width:int,rgb:binary>>"
    return media.select("doc", "n_bytes", "media").mapInArrow(run, schema)


def _features(stream: bytes, images: list[pjpeg.Image]) -> tuple:
    digest, size, tail, features, tensors = hashlib.sha256(), 0, b"", [], []
    for image in images:
        payload = pjpeg.to_payload(image).tobytes()
        digest.update(payload)
        size, tail = size + len(payload), payload[-16:]
        rgb = pjpeg.to_rgb(image)
        mean = rgb.reshape(-1, 3).mean(0, dtype=np.float64)
        features.append(f"{image.height}x{image.width}:{mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f}:{zlib.crc32(rgb):08x}")
        tensors.append({"height": image.height, "width": image.width, "rgb": rgb.tobytes()})
    return size, digest.hexdigest(), zlib.crc32(tail), len(stream), hashlib.sha256(stream).hexdigest(), ";".join(features), tensors
