"""Texts as media columns: bytes become grey samples of lossless WebP frames, are stored, read back and described.

A payload is cut into frames of ``width`` columns and at most ``rows`` rows, so one image is bounded however long the
text; the stored form is the frames' files, one after another.  ``decode_images`` opens any column of such files.

Defined results: a null text is empty; every payload has at least one block of ``block`` bytes; equal texts give equal
values; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.session import ship_package

from .common import staged
from .webp import decode, decode_gray_many, encode_gray

BLOCK, WIDTH, ROWS = 64, 64, 256


def padded(text: str | None, block: int = BLOCK) -> tuple[bytes, int]:
    """(payload, bytes of the text): zeros are added up to a positive multiple of ``block``."""
    data = (text or "").encode()
    return data + bytes(-len(data) % block or (0 if data else block)), len(data)


def store(payload: bytes, width: int = WIDTH, rows: int = ROWS) -> bytes:
    samples = np.frombuffer(payload, dtype=np.uint8)
    return b"".join(encode_gray(samples[at : at + width * rows], width) for at in range(0, len(samples), width * rows))


def frames(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def feature(samples: np.ndarray) -> str:
    """Shares of eight brightness classes, in 255ths, as hexadecimal digits."""
    return bytes((np.bincount(samples >> 5, minlength=8) * 255 // len(samples)).astype(np.uint8)).hex()


def encode_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as WebP frames."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                payloads = [padded(x.as_py()) for x in part.column(1)]
                media = pa.array([store(p) for p, _ in payloads], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in payloads], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr(f"cast(`{key}` as long) AS doc_id", f"`{text}` AS text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """Decodes ``media`` and gives the digests and features of the pixel arrays."""
    ship_package(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(2).to_pylist()
            cut = [frames(m) for m in stored]
            pixels = decode_gray_many([f for fs in cut for f in fs])
            rows, at = [], 0
            for m, fs in zip(stored, cut, strict=True):
                samples = np.concatenate(pixels[at : at + len(fs)])
                at += len(fs)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def decode_images(media: DataFrame) -> DataFrame:
    """``doc_id, frame, width, height, pixels``: every image of ``media`` (doc_id, media), of any colours, as rows of little-endian ARGB."""
    ship_package(media.sparkSession)
    names = ["doc_id", "frame", "width", "height", "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, stored in zip(batch.column(0), batch.column(1), strict=True):
                images = [decode(f) for f in frames(stored.as_py() or b"")]
                columns = ([doc.as_py()] * len(images), range(len(images)), [i.shape[1] for i in images], [i.shape[0] for i in images], [i.astype("<u4").tobytes() for i in images])
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.selectExpr("cast(doc_id as long) AS doc_id", "media").mapInArrow(run, "doc_id long, frame int, width int, height int, pixels binary")


def media_columns(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as a media column and describes what is read back."""
    return describe_media(staged(encode_media(docs, key=key, text=text), "media"))
