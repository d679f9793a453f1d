"""Token ids in raw binary shards, with a minimal perfect hash from document keys to shard offsets.

Format. A shard file holds the ids of consecutive documents, little-endian, 2 bytes each if the vocabulary allows it,
else 4, and nothing else. Shards follow each other in ascending key order (range partitioning); within a shard rows are
sorted by key. The entries table (key, occurrence, shard, file, offset, length) is written by Spark and names the file of
the task attempt that won, so that files of lost or repeated attempts are never read. The index table has a row for
each bucket of hashed keys: a minimal perfect hash and, for each slot, a 32-bit fingerprint, shard, offset and length. A lookup is one
hash, one slot, one fingerprint comparison, one ranged read.

Files are written through pyarrow.fs, which reaches local and shared folders, HDFS and object stores by URI.

Defined results: a null text is the empty text (its end id alone); null keys come first; rows that share a key are
told apart by occurrence (0, 1, ... in text order); an empty table gives no shards; other columns play no part.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import LOWER_TABLE, Memo, Scratch, filesystem, mix64, shuffle_partitions
from tapeloom.llm.mphf import Mphf

#: Keys per bucket of the index, about.
BUCKET_KEYS = 50_000
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("length", "<i8")])
#: Distinct words whose ids a worker remembers at most, in each of two generations.
MEMO = 500_000
#: ASCII marks that the tokenizers' patterns keep together; an apostrophe may begin a pre-token of its own.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases and drops white space, word by word with a memo.

    Such a tokenizer's ids of a text are those of its white-space-separated words in turn, so a word that is remembered
    need not go through the library again. Only ASCII white space separates words here, and only words that are all ASCII
    and hold no "<|" are lower-cased ahead: the library composes marks with capitals and finds its special tokens before it
    lower-cases. It sees everything else as it is. Words new to the memo go through it together where the word-end tokens
    tell whose ids are whose, else one by one."""

    def __init__(self, path: str, dtype: str):
        self.library, self.dtype, self.memo = _tokenizer(path), np.dtype(dtype), Memo(MEMO)
        suffix = self.library.model.end_of_word_suffix
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)

    def _ids(self, text: str) -> np.ndarray:
        # The library's fast form leaves out the offsets in the text, which nothing here reads; the ids are the same.
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found: dict[bytes, bytes] = {}
        plain, parts = [], []  # words of a known number of pre-tokens: letters, then marks
        for w in words:
            core = w.rstrip(MARKS)
            if not core or core.decode().isalpha():
                plain.append(w)
                parts.append((len(core) > 0) + (len(core) < len(w)))
            else:
                found[w] = self._ids(w.decode()).tobytes()
        for at in range(0, len(plain), 2048):
            some, own = plain[at : at + 2048], np.cumsum(parts[at : at + 2048])
            ids = self._ids(b" ".join(some).decode())
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == own[-1]:  # no word has fewer than its parts, so none has more
                flat, stops = ids.tobytes(), (ends[own - 1] * self.dtype.itemsize).tolist()
                found.update(zip(some, (flat[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
            else:
                found.update((w, self._ids(w.decode()).tobytes()) for w in some)
        return [found[w] for w in words]

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        if text.isascii() and b"<|" not in text:
            return text.translate(LOWER_TABLE).split()
        return [w.translate(LOWER_TABLE) if w.isascii() and b"<|" not in w else w for w in text.split()]

    def payloads(self, texts: list[bytes]) -> list[bytes]:
        words = [self._words(t) for t in texts]
        get, missing = self.memo.rotate().get, set()
        found = []
        for own in words:
            values, gaps, at = list(map(get, own)), [], -1
            try:
                while True:
                    at = values.index(None, at + 1)
                    gaps.append(at)
            except ValueError:
                missing.update([own[i] for i in gaps])
            found.append((values, gaps))
        known = self.memo.of(missing, self._encode)
        out = []
        for own, (values, gaps) in zip(words, found, strict=True):
            for i in gaps:
                values[i] = known[own[i]]
            out.append(b"".join(values))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> WordEncoder:
    """One for each Python worker, over all its tasks."""
    return WordEncoder(path, dtype)


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, scratch: Scratch, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shards and returns the entries table: key, occurrence, shard, file, start (in the shard), length."""
    dtype, root = width(vocabulary), scratch.path("shards")
    end = np.array([end_id], dtype).tobytes()
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards or shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = _encoder(tokenizer, dtype), TaskContext.get().partitionId()
        fs, top = filesystem(root)
        fs.create_dir(top, recursive=True)
        file, out, start, last, nth = f"{shard:06d}-{uuid.uuid4().hex[:12]}.bin", None, 0, object(), 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 1024)
                at += part.num_rows
                keys = part.column("key").to_pylist()
                payloads = [p + end for p in encoder.payloads(part.column("text").cast(pa.binary()).to_pylist())]
                out = out or fs.open_output_stream(f"{top}/{file}")
                out.write(b"".join(payloads))
                lengths, starts, nths = [], [], []
                for k, p in zip(keys, payloads, strict=True):
                    nth = nth + 1 if k == last else 0
                    last = k
                    nths.append(nth)
                    starts.append(start)
                    lengths.append(len(p) // len(end))
                    start += lengths[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(nths, pa.int64()), pa.array([shard] * len(keys), pa.int32()), pa.array([file] * len(keys)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["key", "occurrence", "shard", "file", "start", "length"],
                )
        if out:
            out.close()

    return scratch.write(rows.mapInArrow(run, "key bigint, occurrence bigint, shard int, file string, start bigint, length bigint"), "entries")


def _keys(t: pa.Table) -> np.ndarray:
    key = t.column("key")
    return np.stack([key.fill_null(0).to_numpy().view(np.uint64), (t.column("occurrence").to_numpy() * 2 + key.is_null().to_numpy()).view(np.uint64)], 1)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(mix64(keys[:, 0], 101) ^ keys[:, 1], 102) >> np.uint64(32)).astype(np.uint32)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key", "occurrence"), F.lit(buckets)).cast("int")


def build_index(entries: DataFrame, buckets: int) -> DataFrame:
    def build(t: pa.Table) -> pa.Table:
        keys = _keys(t)
        hashed = Mphf.build(keys)
        slots = np.zeros(hashed.size, SLOT)
        at = hashed.lookup(keys)
        slots["fingerprint"][at] = _fingerprint(keys)
        for name, column in (("shard", "shard"), ("offset", "start"), ("length", "length")):
            slots[name][at] = t.column(column).to_numpy()
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "hash": [hashed.dump()], "slots": [slots.tobytes()]})

    return entries.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, "bucket int, hash binary, slots binary")


def locate(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """key, occurrence, shard, start, length of the keys (key, occurrence) that the index has; others give no row."""

    def probe(one: pa.Table, two: pa.Table) -> pa.Table:
        found, own = np.zeros(0, np.int64), np.zeros(0, SLOT)
        if one.num_rows and two.num_rows:
            asked = _keys(one)
            slots = np.frombuffer(two.column("slots")[0].as_py(), SLOT)
            at = Mphf.load(two.column("hash")[0].as_py()).lookup(asked)
            found = np.flatnonzero((at >= 0) & (slots["fingerprint"][np.maximum(at, 0)] == _fingerprint(asked)))
            own = slots[at[found]]
        some = one.take(pa.array(found))
        return pa.table({"key": some.column("key"), "occurrence": some.column("occurrence"), "shard": own["shard"].copy(), "start": own["offset"].copy(), "length": own["length"].copy()})

    return keys.withColumn("bucket", _bucket(buckets)).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, "key bigint, occurrence bigint, shard int, start bigint, length bigint")


def directory(entries: DataFrame) -> DataFrame:
    """A row for each shard: its file, its ids, and the ids of all shards before it."""
    from pyspark.sql import Window

    per = entries.groupBy("shard").agg(F.min("file").alias("file"), F.sum("length").alias("ids"))
    return per.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(located: DataFrame, shards: DataFrame, vocabulary: int, scratch: Scratch, partitions: int, then) -> DataFrame:
    """Reads the payloads of located rows; then(ids as a numpy array) -> long goes into the column found.

    Rows are dealt by shard and sorted by offset, so that a task reads its files forward, a block at a time."""
    dtype, root = np.dtype(width(vocabulary)), scratch.path("shards")
    rows = located.join(shards.select("shard", "file", "base"), "shard").repartition(partitions, "shard").sortWithinPartitions("shard", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(root)
        name, file = None, None
        for batch in batches:
            found = []
            for own, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                if own != name:
                    name, file = own, fs.open_input_file(f"{top}/{own}")
                file.seek(start * dtype.itemsize)
                found.append(then(np.frombuffer(file.read(length * dtype.itemsize), dtype)))
            start = pa.array(np.asarray(batch.column("base")) + np.asarray(batch.column("start")))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("occurrence"), start, batch.column("length"), pa.array(found, pa.int64())], names=["key", "occurrence", "start", "length", "found"])

    return rows.mapInArrow(run, "key bigint, occurrence bigint, start bigint, length bigint, found bigint")
