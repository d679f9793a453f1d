"""Blocks ask, shards answer: an exchange in which only packed keys move, never the blocks.

A block of documents sends each shard one row with the sorted keys it asks about; a shard answers each block with one row, in
the order asked. Answers are written to the shared folder in buckets of blocks and sorted by block, and a task that has a
block in hand reads that block's answers there.
"""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import filesystem


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return zstandard.compress(raw, 1)


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def narrow(a: np.ndarray) -> np.ndarray:
    """Counts or numbers in the least of 1, 2, 4, 8 bytes that holds them all."""
    most = int(a.max(initial=0))
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def pack_counts(a: np.ndarray) -> bytes:
    own = narrow(a)
    return bytes([own.itemsize]) + pack(own)


def unpack_counts(blob: bytes) -> np.ndarray:
    return unpack(blob[1:], f"<u{blob[0]}").astype(np.int64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards as equal ranges of 64-bit hashes, so that sorted hashes are cut in slices."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int")


def store_answers(answers: DataFrame, path: str, buckets: int) -> None:
    rows = answers.withColumn("bucket", bucket_of(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block", "shard")
    rows.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_answers(root: str, bucket: int, block: int) -> list[dict]:
    """A block's answers by shard; none if there are none."""
    fs, top = filesystem(root)
    try:
        found = pq.ParquetDataset(f"{top}/bucket={bucket}", filesystem=fs, filters=[("block", "=", block)], partitioning=None)
    except FileNotFoundError:
        return []  # no block of this bucket asked for anything
    return found.read().sort_by("shard").to_pylist()
