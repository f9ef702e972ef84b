"""Media columns: texts or other bytes kept as losslessly stored 8-bit images in archive directories.

A payload (the bytes, padded with 255 to a positive multiple of ``SAMPLES``) becomes a
greyscale PNG of ``SAMPLES`` columns; members are appended to archives with a header of
id, size and CRC-32.  The data source ``media_archive`` plans byte ranges over the
archives, streams payloads through Arrow in batches of bounded size, and retries
each member by its offset; a member that stays damaged is a row with an error, not a failed job.

Cases: null text is empty, and its payload all padding; null ids stay null; equal
texts have equal stored forms; very long texts are one member; an empty table
writes no archive and reads no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .archives import BATCH, ArchiveWriter, RangeReader
from .storage import temporary
from .words import string_bytes

SAMPLES, PAD = 576, 255
_PNG = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
_HEAD = struct.Struct("<4sBqII")  # magic, has id, id, size, CRC-32 of the media

SCHEMA = "archive string, offset long, doc_id long, n_bytes long, media binary, payload binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(SAMPLES, -(-len(data) // SAMPLES) * SAMPLES) - len(data))


def encode_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // SAMPLES, SAMPLES + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    head = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 2)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """Samples of an 8-bit greyscale PNG whose rows are unfiltered, as ``encode_png`` writes them."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, size, data = 8, None, b""
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if size[2:] != (8, 0, 0, 0, 0) or rows[:, 0].any():
        raise ValueError("PNG of another kind")
    return rows[:, 1:].tobytes()


class MediaWriter(ArchiveWriter):
    suffix = ".media"

    def members(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        data, offsets = string_bytes(batch.column(1))
        for i, doc in enumerate(batch.column(0).to_pylist()):
            media = encode_png(padded(data[offsets[i] : offsets[i + 1]].tobytes()))
            yield _HEAD.pack(b"MBR1", doc is not None, doc or 0, len(media), zlib.crc32(media)) + media


class MediaReader(RangeReader):
    suffix = ".media"

    def checked(self, data: bytes) -> bytes:
        magic, _, _, size, crc = _HEAD.unpack_from(data)
        if magic != b"MBR1" or size != len(data) - _HEAD.size or crc != zlib.crc32(data[_HEAD.size :]):
            raise ValueError("member is damaged")
        return data

    def rows(self, members) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for archive, offset, data, error in members:
            doc = n = media = payload = None
            if data is not None:
                _, known, doc, _, _ = _HEAD.unpack_from(data)
                doc, media = (doc if known else None), data[_HEAD.size :]
                try:
                    payload = decode_png(media)
                    n = len(payload.rstrip(bytes([PAD])))  # 255 never occurs in UTF-8
                except (ValueError, zlib.error) as e:
                    error = str(e)
            rows.append((archive, offset, doc, n, media, payload, error))
            size += len(payload or b"") + len(media or b"")
            if size >= BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(dict(self.options))


def store_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the texts of every row as media archives; gives the directory."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaSource)
    path = path or temporary(spark, "media")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).write.format("media_archive").mode("append").save(path)
    return path


def load(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").options(**options).load(path)


def features(samples: np.ndarray) -> str:
    """Rows, mean, deviation, eight-step histogram and the average hash of an 8 x 8 reduction."""
    rows = samples.reshape(-1, SAMPLES)
    n, total = samples.size, int(samples.sum(dtype=np.int64))
    squares = int((samples.astype(np.int64) ** 2).sum())
    steps = np.bincount(samples >> 5, minlength=8)
    cells = rows.sum(axis=0, dtype=np.int64).reshape(64, SAMPLES // 64).sum(axis=1)
    bits = np.packbits(cells * 64 > total).tobytes().hex()
    return f"rows={len(rows)};mean={total / n:.4f};sd={max(squares / n - (total / n) ** 2, 0) ** 0.5:.4f};steps={','.join(map(str, steps))};ahash={bits}"


def with_features(media: DataFrame) -> DataFrame:
    """Rows of ``load`` with a string ``feature``; the bytes themselves are digested by Spark."""

    def of(batches):
        for b in batches:
            out = [None if x.as_py() is None else features(np.frombuffer(x.as_py(), np.uint8)) for x in b.column("payload")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, "feature"])

    payload, stored = F.col("payload"), F.col("media")
    rows = media.select("doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"), F.length(stored).cast("long").alias("media_bytes"), F.sha2(stored, 256).alias("media_sha256"), "error", "payload")
    kept = rows.columns[:-1]
    return rows.mapInArrow(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string, feature string")
