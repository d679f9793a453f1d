"""Suffix-array dedup of repeated byte spans by external induced sorting.

A byte goes if a string of SPAN bytes covers it that also starts in a document with a smaller key. Suffixes that can agree
for SPAN bytes are brought together first: the least hash of the ANCHOR-byte strings inside a window of SPAN bytes is the window's mark,
and equal windows have equal marks. Consecutive windows with one mark form a piece of text. Marks that a single document
holds can't matter; of the others each distinct piece goes to its mark's shard once for each block of documents, with the least key
that has it there. A shard sorts the suffixes of its distinct pieces (induced.py: queues on disk, common prefixes carried
along), and windows whose common prefix reaches SPAN form a group, whose least key decides. A full shard's queues pass QUEUE
and spill; its symbols, owners and results are memory maps. Its pieces, its S* suffixes and their ranks are held in memory. Beyond
BASE of these the sorter recurses, which takes over thirty times as long (over 90 s against 2.7 s for a full shard), so
shards are cut to stay below it; only a mark that very many different pieces share makes a larger one.

What moves are marks and distinct pieces, never pairs: copies of a passage meet as one piece, and its holders only compare
their key with the group's least.

Defined results: a null text is the empty text; very long texts are read whole; rows repeated under a key are judged each; spans are judged on the input; equal keys don't remove each other; null
keys count as greater than all others; texts shorter than SPAN are kept; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Scratch, mix64, pieces, utf8
from tapeloom.llm.exchange import bucket_of, pack, pack_counts, read_answers, shard_of, store_answers, unpack, unpack_counts
from tapeloom.llm.induced import suffixes

SPAN, ANCHOR = 50, 20
#: Bytes of text per block and per shard, about; windows per piece at most.
BLOCK, SHARD, PIECE = 4 << 20, 3 << 20, 256
#: S* suffixes sorted in memory, and bytes of queue held in memory, at most.
BASE, QUEUE = 1 << 22, 1 << 20
NONE = np.iinfo(np.int64).max


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, n, keys, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            cols = [pa.array([pid << 24 | n], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([pack_counts(np.array([len(t) for t in texts], np.int64))], pa.binary()), pa.array([zstandard.compress(b"".join(texts), 1)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "keys", "lengths", "text"])

        for batch in pieces(batches):
            for k, t in zip(batch.column("key").to_pylist(), utf8(batch.column("text")), strict=True):
                keys.append(k)
                texts.append(t)
                size += len(t) + 64
                if size >= BLOCK:
                    yield close()
                    n, keys, texts, size = n + 1, [], [], 0
        if keys:
            yield close()

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, "block bigint, keys array<bigint>, lengths binary, text binary")


class Block:
    """A block in hand: its bytes, its documents and the runs of windows that share a mark."""

    def __init__(self, row: dict):
        self.flat = zstandard.decompress(row["text"])
        self.bytes = np.frombuffer(self.flat, np.uint8)
        self.lengths = unpack_counts(row["lengths"])
        self.ends = np.cumsum(self.lengths)
        self.names = row["keys"]
        self.keys = np.array([NONE if k is None else k for k in self.names], np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, numbers of windows and marks of the runs."""
        n = len(self.bytes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        padded = np.concatenate([self.bytes, np.zeros(ANCHOR + 8, np.uint8)])
        words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n + ANCHOR, 8), (1, 1))).view("<u8").ravel()
        h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        h += words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        h += (words[16 : n + 16] & np.uint64(0xFFFFFFFF)) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        reach, width = 1, SPAN - ANCHOR + 1
        while reach < width:
            step = min(reach, width - reach)
            np.minimum(h[:-step], h[step:], out=h[:-step])
            reach += step
        first = self.ends - self.lengths
        windows = np.maximum(0, self.lengths - SPAN + 1)
        live = np.zeros(n + 1, np.int8)
        np.add.at(live, first[windows > 0], 1)
        np.add.at(live, (first + windows)[windows > 0], -1)
        inside = np.cumsum(live[:n], dtype=np.int8) > 0
        cut = np.append(True, h[1:] != h[:-1])
        cut[first[self.lengths > 0]] = True
        edge = np.flatnonzero(np.append(cut | ~inside, True))
        starts, stops = edge[:-1], edge[1:]
        some = inside[starts]
        return starts[some], (stops - starts)[some], mix64(h[starts[some]])  # mixed: least hashes are all small, shards are ranges

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


MARKS = "shard int, block bigint, marks binary, several binary"


def _ask_marks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = Block(r)
                starts, _, marks = own.runs()
                distinct, at = np.unique(marks, return_inverse=True)
                key = own.keys[own.documents(starts)]
                least, most = np.full(len(distinct), NONE), np.full(len(distinct), -NONE)
                np.minimum.at(least, at, key)
                np.maximum.at(most, at, key)
                several = least < most
                cuts = np.searchsorted(shard_of(distinct, shards), np.arange(shards + 1))
                rows = [(s, r["block"], pack(distinct[a:b]), np.packbits(several[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "block", "marks", "several"])

    return run


def _answer_marks(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    asked = [unpack(r["marks"], "<u8") for r in rows]
    distinct, at = np.unique(np.concatenate(asked), return_inverse=True)
    shared = np.bincount(at, minlength=len(distinct)) > 1
    shared[at[np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(a)) for r, a in zip(rows, asked, strict=True)]) > 0]] = True
    out, begin = [], 0
    for a in asked:
        out.append(np.packbits(shared[at[begin : begin + len(a)]]).tobytes())
        begin += len(a)
    counts = [len(a) for a in asked]
    return pa.table({"shard": t.column("shard"), "block": t.column("block"), "bits": pa.array(out, pa.binary()), "n": pa.array(counts, pa.int64())})


def _bits(answers: list[dict]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in answers] or [np.zeros(0, np.uint8)]) > 0


PIECES = "kind string, shard int, block bigint, a binary, b binary, c binary"


def _ask_pieces(root: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = Block(r)
                starts, counts, marks = own.runs()
                at = np.unique(marks, return_inverse=True)[1]
                shared = _bits(read_answers(root, r["bucket"], r["block"]))[at]
                starts, counts, marks = starts[shared], counts[shared], marks[shared]
                parts = -(-counts // PIECE)
                nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                starts, counts, marks = np.repeat(starts, parts) + nth * PIECE, np.minimum(PIECE, np.repeat(counts, parts) - nth * PIECE), np.repeat(marks, parts)
                flat, index = own.flat, {}
                which = np.fromiter((index.setdefault(flat[a:b], len(index)) for a, b in zip(starts.tolist(), (starts + counts + SPAN - 1).tolist(), strict=True)), np.int64, len(starts))
                key = own.keys[own.documents(starts)]
                least = np.full(len(index), NONE)
                np.minimum.at(least, which, key)
                shard = np.zeros(len(index), np.int64)
                shard[which] = shard_of(marks, shards)
                order = np.argsort(shard, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                texts = list(index)
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = []
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        mine = [texts[i] for i in order[a:b].tolist()]
                        rows.append(("ask", s, r["block"], zstandard.compress(b"".join(mine), 1), pack_counts(np.array([len(x) for x in mine])), pack(least[order[a:b]])))
                rows.append(("local", -1, r["block"], pack_counts(np.diff(starts, prepend=0)), pack_counts(counts), pack_counts(place[which])))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=["kind", "shard", "block", "a", "b", "c"])

    return run


def least_keys(texts: list[bytes], keys: np.ndarray, folder: str, base: int = BASE, queue: int = QUEUE) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each text the least key of the texts that have it: values by place, and each text's first place."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = int(lengths.sum()) + len(texts) + 1
    symbols, owner, least = (np.memmap(f"{folder}/{name}", kind, "w+", shape=n) for name, kind in (("symbols", np.uint16), ("owner", np.int64), ("least", np.int64)))
    least[:] = NONE
    symbols[:] = 1  # 1 between texts, 0 at the end
    for some in range(0, len(texts), 4096):  # texts follow each other, so a run of them is one slice
        own, stop = texts[some : some + 4096], min(len(texts), some + 4096)
        a, b, size = int(starts[some]), int(starts[stop - 1] + lengths[stop - 1] + 1), lengths[some:stop]
        at = np.arange(size.sum()) + np.repeat(np.arange(len(own)), size)
        symbols[a:b][at] = np.frombuffer(b"".join(own), np.uint8).astype(np.uint16) + 2
        owner[a:b] = np.repeat(keys[some:stop], size + 1)
    symbols[-1], owner[-1] = 0, NONE
    open_at, open_least = [], NONE
    for at, prefix in suffixes(symbols, SPAN, base, folder, queue):
        new = prefix < SPAN
        heads = np.flatnonzero(new)
        own = owner[at]
        stop = heads[0] if len(heads) else len(at)
        if stop:
            open_at.append(at[:stop])
            open_least = min(open_least, int(own[:stop].min()))
        if len(heads):
            for a in open_at:
                least[a] = open_least
            mins = np.minimum.reduceat(own, heads)
            sizes = np.diff(np.append(heads, len(at)))
            least[at[stop:]] = np.repeat(mins, sizes)
            open_at, open_least = [at[heads[-1] :]], int(mins[-1])
    for a in open_at:
        least[a] = open_least
    return least, starts


def _answer_pieces(t: pa.Table) -> pa.Table:
    rows, index, asked = t.to_pylist(), {}, []
    for r in rows:
        flat, ends = zstandard.decompress(r["a"]), np.cumsum(unpack_counts(r["b"])).tolist()
        asked.append(np.fromiter((index.setdefault(flat[a:b], len(index)) for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
    keys = np.full(len(index), NONE)
    own = [unpack(r["c"], "<i8") for r in rows]
    for a, k in zip(asked, own, strict=True):
        np.minimum.at(keys, a, k)
    texts = list(index)
    with tempfile.TemporaryDirectory() as folder:  # the task's own, as for Spark's sorts; nobody else reads it
        least, starts = least_keys(texts, keys, folder)
    windows = np.array([len(x) - SPAN + 1 for x in texts], np.int64)
    out, counts = [], []
    for a, k in zip(asked, own, strict=True):
        n = windows[a]
        at = np.arange(n.sum()) + np.repeat(starts[a] - np.cumsum(n) + n, n)
        out.append(np.packbits(least[at] < np.repeat(k, n)).tobytes())
        counts.append(int(n.sum()))
    return pa.table({"shard": t.column("shard"), "block": t.column("block"), "bits": pa.array(out, pa.binary()), "n": pa.array(counts, pa.int64())})


def _apply(asks: str, answers: str):
    spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = Block(r)
                n = len(own.bytes)
                hit = np.zeros(n + 1, np.int32)
                local = read_answers(asks, r["bucket"], r["block"])[0]
                starts, counts, which = np.cumsum(unpack_counts(local["a"])), unpack_counts(local["b"]), unpack_counts(local["c"])
                if len(starts):
                    bits = _bits(read_answers(answers, r["bucket"], r["block"]))
                    size = np.zeros(which.max() + 1, np.int64)
                    size[which] = counts
                    first = np.cumsum(size) - size
                    key = own.keys[own.documents(starts)]
                    least = np.full(len(size), NONE)
                    np.minimum.at(least, which, key)
                    ahead = np.cumsum(counts) - counts
                    nth = np.arange(counts.sum()) - np.repeat(ahead, counts)
                    gone = bits[np.repeat(first[which], counts) + nth] | np.repeat(key > least[which], counts)
                    hit[(np.repeat(starts, counts) + nth)[gone]] = 1
                total = np.cumsum(hit[:n])
                covered = total.copy()
                covered[SPAN:] -= total[:-SPAN] if n > SPAN else 0
                covered = covered > 0
                begin = np.zeros(n, bool)
                begin[(own.ends - own.lengths)[own.lengths > 0]] = True
                rise = np.flatnonzero(covered & (begin | ~np.append(False, covered[:-1]))) if n else np.zeros(0, np.int64)
                fall = np.flatnonzero(covered & np.append(begin[1:] | ~covered[1:], True)) + 1 if n else np.zeros(0, np.int64)
                doc = own.documents(rise)
                offset = (own.ends - own.lengths)[doc]
                spans = pa.StructArray.from_arrays([pa.array(rise - offset), pa.array(fall - offset)], names=["from", "to"])
                stops = np.append(0, np.cumsum(np.bincount(doc, minlength=len(own.keys)))).astype(np.int32)
                kept = own.bytes[~covered].tobytes()
                ends = np.append(0, np.cumsum(~covered))[np.append(0, own.ends)].tolist()
                texts = [kept[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(own.names, pa.int64()), pa.array(own.lengths), pa.ListArray.from_arrays(pa.array(stops), spans).cast(spans_type), pa.array(texts, pa.binary())], names=["key", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_bytes, spans (removed byte intervals) and kept (the bytes left)."""
    scratch = Scratch(df.sparkSession, "span-dedup")
    cut = scratch.write(blocks(df, key, text), "blocks")
    count = cut.count()
    buckets, shards = max(1, -(-count // 4)), max(1, count * BLOCK // SHARD)
    cut = cut.withColumn("bucket", bucket_of(buckets))
    store_answers(cut.mapInArrow(_ask_marks(shards), MARKS).groupBy("shard").applyInArrow(_answer_marks, "shard int, block bigint, bits binary, n bigint"), scratch.path("marks"), buckets)
    scratch.release()
    cut.mapInArrow(_ask_pieces(scratch.path("marks"), shards), PIECES).write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path("pieces"))
    asked = df.sparkSession.read.schema(PIECES).parquet(scratch.path("pieces"))
    store_answers(asked.where("kind = 'local'").drop("kind"), scratch.path("local"), buckets)
    answers = asked.where("kind = 'ask'").drop("kind").groupBy("shard").applyInArrow(_answer_pieces, "shard int, block bigint, bits binary, n bigint")
    store_answers(answers, scratch.path("answers"), buckets)
    scratch.drop("pieces", "marks")
    scratch.release()
    schema = "key bigint, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, kept binary"
    return cut.mapInArrow(_apply(scratch.path("local"), scratch.path("answers")), schema).withColumnRenamed("key", key)
