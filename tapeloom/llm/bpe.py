"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte runs. Every adjacent pair whose joined bytes have a rank waits in the bucket of
that rank; two levels of 256-bit words say which buckets hold anything, so find-first-set finds the lowest rank in
two steps whatever the pre-token's length. A bucket gives its leftmost position first. Entries whose pair has
changed meanwhile are stale: they are skipped when they come up. The work is O(n log n) for n bytes.

Defined results: a null text is the empty text, which has no ids; texts are encoded whole, whatever their length;
special tokens are never recognised; repeated rows are encoded each; an empty table gives no rows; columns of the
input whose names clash with the output's are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.llm.common import Memo, list_array, pieces

#: Pre-tokens whose ids a worker remembers at most, in each of two generations.
MEMO = 350_000


_BIT = [1 << i for i in range(256)]


class RankQueue:
    """Positions by rank; pops the leftmost position of the lowest rank. Reusable once it has run empty."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 8) + 1)  # which ranks of each 256 hold anything
        self.top = 0  # which of those words are not zero
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 8] |= _BIT[rank & 255]
            self.top |= 1 << (rank >> 8)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; raises IndexError when empty."""
        top = self.top
        if not top:
            raise IndexError("empty")
        high = (top & -top).bit_length() - 1
        word = self.low[high]
        rank = high << 8 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        word &= word - 1
        self.low[high] = word
        if not word:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Codec:
    """Encodes and decodes by a table of ranks; every match of the pattern is encoded on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.bytes = {i: b for b, i in ranks.items()}
        self.memo = Memo(MEMO)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        get = ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        waiting = [get(piece[i : i + 2], -1) for i in range(n)]  # the rank of the pair that starts here
        waiting[n - 1] = -1
        # The queue's push() and pop() in place: a call for each pair costs as much as what it does. It is empty here and in the end.
        low, buckets, top = self.queue.low, self.queue.buckets, 0
        for i, rank in enumerate(waiting):
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= _BIT[rank & 255]
                    top |= 1 << (rank >> 8)
        while top:
            high = (top & -top).bit_length() - 1
            word = low[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[high] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if waiting[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[gone]
            after[i] = end
            before[end] = i
            waiting[gone] = -1
            waiting[i] = new = get(piece[i : after[end]], -1) if end < n else -1
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    low[new >> 8] |= _BIT[new & 255]
                    top |= 1 << (new >> 8)
            left = before[i]
            if left >= 0:
                new = get(piece[left:end], -1)
                if waiting[left] != new:
                    waiting[left] = new
                    if new >= 0:
                        if new in buckets:
                            heappush(buckets[new], left)
                        else:
                            buckets[new] = [left]
                            low[new >> 8] |= _BIT[new & 255]
                            top |= 1 << (new >> 8)
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(ranks[piece[i:end]])
            i = end
        return out

    def encode(self, text: str) -> np.ndarray:
        parts = self.split(text)
        values = list(map(self.memo.rotate().get, parts))
        if None in values:
            gaps = [i for i, v in enumerate(values) if v is None]
            known = self.memo.of({parts[i] for i in gaps}, self._encode)
            for i in gaps:
                values[i] = known[parts[i]]
        return np.frombuffer(b"".join(values), "<i4")

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [pack(f"<{len(ids)}i", *ids) for ids in map(self.merge, map(str.encode, parts))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file (lines of base64 bytes and rank); once for each Python worker."""
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *fields])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the ids of each whole text in the column ids (array of int), and in the column decoded, if named, the bytes that
    those ids decode to: one pass of one worker does both."""
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType(), False))
    out = _with(df, *fields)
    keep = out.names[: -len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in pieces(batches, 128):
            found = [own.encode(t or "") for t in batch.column(text).to_pylist()]
            cols = [list_array(np.concatenate(found), [len(x) for x in found])]
            if decoded:
                cols.append(pa.array([own.decode(x) for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=out.names)

    return df.mapInArrow(run, out)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for in the column decoded (binary); null ids decode to no bytes."""
    out = _with(df, T.StructField(decoded, T.BinaryType(), False))
    keep = out.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in pieces(batches):
            column = batch.column(ids)
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            found = [own.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.binary())], names=[*keep, decoded])

    return df.mapInArrow(run, out)
