"""Media columns: texts kept as lossless WebP images of their bytes, and features of the pixels read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeframe.llm import webp
from lodeframe.llm.common import utf8

WIDTH = 64


def payload_of(text: bytes) -> bytes:
    """The bytes with 0 appended up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def to_media(payload: bytes) -> bytes:
    """Grey WebP files of 64 samples a row, one after another: the first rows, then the next 16,384, and so on."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode_grey(rows[i : i + webp.MAX_SIDE]) for i in range(0, len(rows), webp.MAX_SIDE))


def from_media(media: bytes) -> np.ndarray:
    """The samples [rows, 64] of to_media(), by decoding its files."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        image = webp.decode(media[at : at + size])
        parts.append(image[..., 2])
        at += size
    return np.concatenate(parts)


def feature(samples: np.ndarray) -> str:
    """Rows, mean of all samples and a 64-bit mean hash: bit i is set where the i-th of 64 equal runs of samples
    is brighter than the image."""
    flat = samples.ravel()
    sums = flat.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(sums * 64 > sums.sum()).tobytes().hex()
    return f"{len(samples)}x{samples.shape[1]}:{int(sums.sum()) / flat.size:.3f}:{bits}"


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row for each row of docs: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature), and media itself if keep_media.

    Everything but n_bytes and the media's own size and hash is computed from the samples read back. Null texts
    are empty ones, whose payload is 64 zero bytes. Equal texts give equal values; an empty table gives an empty
    result; other columns are not looked at.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                media = to_media(payload_of(text))
                samples = from_media(media)
                read = samples.tobytes()
                rows.append((len(text), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples), *[media] * keep_media))
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names)

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, schema)
