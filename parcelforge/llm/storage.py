"""Shared-folder tables and fixed-size bitmaps."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path, files = _hadoop(spark, at)
    files.deleteOnExit(path)
    return at


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    at = temporary(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for t in tables:
        if t is not None:
            path, files = _hadoop(t.sparkSession, t._stored_at)
            files.delete(path, True)


#: Bits in one block of a bitmap.
BLOCK = 1 << 16


def slots_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two) with bit ``key mod bits`` set for every 64-bit key of the one column of ``keys``.

    Its size is ``bits / 8`` bytes whatever the input: tasks send the blocks they
    touched, blocks are OR-ed by key, and the driver gets each block once.
    """
    width = BLOCK // 8

    def touched(batches):
        own = np.zeros(bits // 8, np.uint8)  # a bit a slot: bytes would take eight times the memory of each task
        for b in batches:
            slot = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(own, (slot >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))
        packed = own.reshape(-1, min(width, bits // 8))
        hit = np.flatnonzero(packed.any(axis=1)) if bits > BLOCK else np.arange(1)
        for i in range(0, len(hit), 64):
            part = hit[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32), pa.int32()), pa.array([zlib.compress(packed[x].tobytes(), 1) for x in part], pa.binary())], ["block", "bytes"])

    def merged(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("bytes"), strict=True):
                y = np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
                own[k] = own[k] | y if k in own else y
        for k, y in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([y.tobytes()], pa.binary())], ["block", "bytes"])

    blocks = keys.mapInArrow(touched, "block int, bytes binary").repartition(8, "block").mapInArrow(merged, "block int, bytes binary")
    out = np.zeros((max(bits // BLOCK, 1), min(width, bits // 8)), np.uint8)
    got = blocks.toArrow()  # one job; bits / 8 bytes in all
    for k, x in zip(got["block"].to_pylist(), got["bytes"].to_pylist(), strict=True):
        out[k] = np.frombuffer(x, np.uint8)
    return out.ravel()


def keyed_in(keys: DataFrame, bits: int = 1 << 26) -> Callable[[Column], Column]:
    """A test of 64-bit key columns against a fixed-size bitmap of ``keys``: true for all of them, and for some others."""
    sent = keys.sparkSession.sparkContext.broadcast(slots_bitmap(keys, bits))

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(sent.value, key.to_numpy().view(np.uint64)))

    return test


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
