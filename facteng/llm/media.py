"""Media columns: texts as progressive JPEG, stored and read back as full-resolution RGB tensors; these are stored as well, and
features are computed from them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import Scratch, documents

#: Parts in which the tensors of a table are stored.
TURNS = 8
#: Bytes of tensors that are handed on together.
PIECE = 8 << 20


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 bytes of a text (null: none), zero bytes appended up to a positive multiple of 64."""
    text = text or b""
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


def feature_of(rgb: np.ndarray) -> str:
    """Height, width, and mean and deviation of each channel."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(axis=0, dtype=np.int64)
    square = np.array([int(np.dot(c, c)) for c in flat.T.astype(np.float32)], dtype=np.float64)
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return ",".join([str(rgb.shape[0]), str(rgb.shape[1])] + [f"{m:.3f}" for m in mean] + [f"{s:.2f}" for s in spread])


SCHEMA = "doc_id long, n_bytes long, media binary"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): the stored form of every text; null texts as empty ones, one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounds what is held at once
                ids, texts = b.column(0)[at : at + 256], b.column(1)[at : at + 256].to_pylist()
                media = [jpeg.encode_payload(payload_of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary")).mapInArrow(run, SCHEMA)


def decode(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb binary): the tensor of every row of media(doc_id, media), row-major RGB bytes. One row per
    row; a null doc_id stays null; media must not be null and must be JPEG, else ValueError; no rows: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rgb = jpeg.to_rgb(jpeg.read_coefficients(b.column(1)[k].as_py()))
                row = [b.column(0)[k : k + 1], pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digests of payload and media, height, width, rgb binary): what the stored bytes of encode() give, with the
    tensor as decode() has it. One row per row; a null doc_id stays null; no rows: no rows."""
    schema = f"doc_id long, n_bytes long, {DIGESTS}, height int, width int, rgb binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, held = [], 0, 0
            for k in range(b.num_rows):
                data = b.column(2)[k].as_py()
                image = jpeg.read_coefficients(data)
                payload, rgb = jpeg.decode_payload(image), jpeg.to_rgb(image)
                sums = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest())
                rows.append((*sums, rgb.shape[0], rgb.shape[1], rgb.tobytes()))
                held += rgb.nbytes
                if held > PIECE or k == b.num_rows - 1:  # bounds what is held at once
                    cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([b.column(0)[first : k + 1], b.column(1)[first : k + 1], *cols], names)
                    rows, first, held = [], k + 1, 0

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def features(tensors: DataFrame) -> DataFrame:
    """The rows of read_back() with a column feature, computed from their tensors, in place of these."""
    schema = f"doc_id long, n_bytes long, {DIGESTS}, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            high, wide = b.column("height").to_pylist(), b.column("width").to_pylist()
            found = [feature_of(np.frombuffer(x.as_buffer(), np.uint8).reshape(h, w, 3)) for h, w, x in zip(high, wide, b.column("rgb"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-1]], pa.array(found, pa.string())], names)

    return tensors.mapInArrow(run, schema)


def digests(media: DataFrame, turns: int = 1) -> DataFrame:
    """What the stored bytes of encode() give when they are read back: payload, checksums and features. The tensors are
    written to the shared folder and the features computed from what is read there. With turns the rows whose column turn is
    0, 1, .. come after one another, and the tensors of a turn are deleted once its features are known: at three bytes a pixel
    they take about three times the room of the media. One row per row, equal media with equal values; a null doc_id stays
    null; no rows: no rows."""
    scratch, done = Scratch(media.sparkSession, "tensors"), []
    for turn in range(turns):
        tensors = scratch.save(read_back(media.where(F.col("turn") == turn) if turns > 1 else media), "tensors", codec="zstd", block=4 * PIECE)
        done.append(scratch.save(features(tensors), "digests", codec="zstd"))
        scratch.drop(tensors)
    return reduce(DataFrame.union, done)


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; null texts are empty ones (one block of zeros); equal texts have equal values. The media are
    written to the shared folder and read back from there, then the tensors they give, an eighth of them at a time."""
    media = encode(documents(spark, sf_dir)).withColumn("turn", F.pmod(F.xxhash64("doc_id", "media"), F.lit(TURNS)).cast("int"))
    return digests(Scratch(spark, "media").save(media, "media", ["turn"], codec="zstd"), TURNS)
