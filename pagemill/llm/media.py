"""Media columns: texts stored as lossless WebP images and read back as pixel arrays.

A text's UTF-8 bytes, with bytes 255 appended up to a positive multiple of 576, are the payload: rows of 144 RGBA
pixels. It is stored as images of at most 16 rows, one behind the other, so that the images of a batch are of like size
and are encoded and decoded together (webp_encoder, webp_lanes). Reading decodes the stored bytes into a column of
pixels, and takes features of them: the mean byte in thousandths, and an average hash of 64 equal stretches.

Defined results: null and empty texts store one row of 255s; equal texts give equal values; repeated rows stay; an
empty table gives no rows; further columns are ignored; bytes that are no lossless WebP raise BadStream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import webp_encoder, webp_lanes
from pagemill.llm.common import hold, slim, texts

ROW = 576
WIDTH = ROW // 4
TILE_ROWS = 16
TAIL = 32


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def store(data: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    tiles, counts = [], []
    for one in data:
        pixels = np.frombuffer(one, np.uint8).reshape(-1, WIDTH, 4)
        tiles += [pixels[at : at + TILE_ROWS] for at in range(0, len(pixels), TILE_ROWS)]
        counts.append(-(-len(pixels) // TILE_ROWS))
    files = iter(webp_encoder.encode_many(tiles))
    return [b"".join(next(files) for _ in range(n)) for n in counts]


def load(media: list[bytes]) -> list[np.ndarray]:
    """The pixels (height, 144, 4) of each stored form."""
    files, counts = [], []
    for form in media:
        at, before = 0, len(files)
        while at < len(form):
            end = at + 8 + int.from_bytes(form[at + 4 : at + 8], "little")
            files.append(form[at:end])
            at = end
        counts.append(len(files) - before)
    tiles = iter(webp_lanes.decode_many(files))
    return [np.concatenate([next(tiles) for _ in range(n)]) for n in counts]


def feature(pixels: np.ndarray) -> str:
    cells = pixels.reshape(64, -1).sum(1, dtype=np.int64)
    total = int(cells.sum())
    bits = np.packbits(cells * 64 > total).tobytes().hex()
    return f"{total * 1000 // pixels.size}:{bits}"


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the stored images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("media", dict)
        for batch in batches:
            data = texts(batch, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in data], pa.int64()), pa.array(store([payload(t) for t in data]), pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return slim(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, height, width, pixels, feature) of (doc_id, n_bytes, media).

    pixels holds red, green, blue and alpha of each pixel, row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("media", dict)
        for batch in batches:
            images = load(batch.column(2).to_pylist())
            more = [
                pa.array([len(x) for x in images], pa.int32()),
                pa.array([WIDTH] * len(images), pa.int32()),
                pa.array([x.tobytes() for x in images], pa.binary()),
                pa.array([feature(x) for x in images], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["doc_id", "n_bytes", "media", "height", "width", "pixels", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, height int, width int, pixels binary, feature string")


def digest(media: DataFrame) -> DataFrame:
    """Payload and features of (doc_id, n_bytes, media), all from the pixels that are read back."""
    return decoded(media).select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -TAIL, TAIL)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
