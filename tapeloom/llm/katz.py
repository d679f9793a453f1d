"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

Layout. Documents are cut into blocks of about BLOCK tokens, training documents first. A block keeps its distinct words (64-bit
hashes) and its tokens as numbers into them, both by falling frequency.

  words   blocks ask shards of the vocabulary for the corpus counts of their distinct words, and for numbers that stand for
          them (one row for each block and shard, packed as byte planes);
  ask     every token goes once, with the order - 1 words before it, to the shard of the word just before it. All that an
          estimate of any order needs of the words that follow a context is then in one shard: lower orders share its last word;
  count   a shard counts its k-grams of all orders for the discounts and keeps what it was sent as one row;
  score   a shard numbers its contexts and k-grams order by order and evaluates its tokens: the discounted estimate where the
          k-gram was seen, else the context's backoff weight times the estimate of order k-1, down to the unigram. A document
          gets back the sum of its tokens' logarithms, not the tokens.

A word with more than HOT tokens is dealt to several shards by the second word before the token (at order 2: by the token), so
contexts of three words and up stay whole. What follows such a word is counted by the parts, summed up in a table, and read by them.
No table is ever broadcast, collected or looked up by name: the driver reads one row of count-of-counts for each shard.

Normalisation. Unigrams share 1 between the training vocabulary and one unknown word. A context's weight is the mass its
discounts left over the lower-order mass of unseen words; if no discount applied, one count is set aside; if every
word was seen, estimates are scaled up. Where Good-Turing gives no discount between 0 and 1 (small corpora), r - 1/2 counts are
used in place of r.

Defined results: a null text is the empty text, which is the end token alone; null keys count as the empty key for the
fold; rows repeated under a key are scored each and counted each; an empty table gives no rows; without training rows the
vocabulary is empty and every token is unknown (probability 1); other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tapeloom.llm.common import Scratch, filesystem, mix64, pieces
from tapeloom.llm.exchange import bucket_of, pack, pack_counts, read_answers, shard_of, store_answers, unpack, unpack_counts

#: Tokens per block; Good-Turing discounts counts up to CUT; tokens of the corpus per shard, about.
BLOCK, CUT, SHARD_TOKENS = 3 << 18, 5, 1 << 20
#: Shards are served in ROUNDS, so that only a part of what moves is in shuffle files beside the table it goes to.
ROUNDS = 3
#: Training tokens of a word beyond which what follows it is dealt to more than one shard.
HOT = 1 << 19
END = xxh64_intdigest(b" ")  # no word holds a space


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 0..CUT+1 (1 beyond CUT); n[r]: how many were seen r times, r up to CUT + 1."""
    out = np.ones(CUT + 2)
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 1.0
        d = (ratio - tail) / (1 - tail) if tail < 1 else 1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def clipped(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, CUT + 1)


def times_seen(counts: np.ndarray) -> np.ndarray:
    """How many counts are 0, 1, ..., CUT + 1."""
    return np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[: CUT + 2]


@dataclass
class Model:
    """What all tasks know: of each order the discounts, and the unigrams' totals."""

    tokens: int = 0
    words: int = 0
    factors: list[np.ndarray] = field(default_factory=list)
    left: float = 1.0  # unigram mass of the unknown word
    scale: float = 1.0

    def unigrams(self, n: np.ndarray, tokens: int, words: int) -> None:
        self.tokens, self.words = tokens, words
        d = discounts(n)
        self.factors = [d]
        if tokens:
            r = np.arange(CUT + 1)
            self.left = float(((1 - d[: CUT + 1]) * r * n[: CUT + 1]).sum() / tokens)
            if self.left <= 0:
                self.left, self.scale = 1 / (tokens + 1), tokens / (tokens + 1)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        seen = self.factors[0][clipped(counts)] * counts / max(1, self.tokens) * self.scale
        return np.where(counts > 0, seen, self.left)

    def weights(self, total: np.ndarray, left: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weight of each context and the factor of its seen estimates: its count, what discounts took from it, the lower-order mass of what follows."""
        safe = np.maximum(total, 1)
        left = left / safe
        none = left <= 0
        scale = np.where(none, safe / (safe + 1.0), 1.0)
        left = np.where(none, 1 / (safe + 1.0), left)
        unseen = 1 - low
        full = unseen <= 1e-12
        scale = np.where(full, scale / np.where(full, 1 - left, 1.0), scale)
        return np.where(total > 0, np.where(full, 0.0, left / np.where(full, 1.0, unseen)), 1.0), scale


BLOCKS = "block bigint, keys array<bigint>, lengths binary, learn bigint, words binary, tokens binary, counts binary"


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, owner = found.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty string there
    return flat.filter(some), np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _block(name: int, learn: int, keys: list, lengths: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """A block's row: learn training documents come first."""
    found = words.dictionary_encode()
    hashes = np.fromiter(map(xxh64_intdigest, found.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(found.dictionary))
    hashes, own = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
    lengths = lengths + 1
    tokens, ends = np.full(int(lengths.sum()), own[-1], np.int64), np.cumsum(lengths) - 1
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = own[found.indices.to_numpy()]
    order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    tokens = rank[tokens]
    counts = np.bincount(tokens[: int(lengths[:learn].sum())], minlength=len(order))
    cols = [[name], [keys], [pack(lengths.astype(np.uint32))], [learn], [pack(hashes[order])], [pack_counts(tokens)], [pack_counts(counts)]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "keys", "lengths", "learn", "words", "tokens", "counts"])


def blocks(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as blocks of tokens; held_out rows are counted nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, n = TaskContext.get().partitionId(), 0
        parts, size = ([], []), 0  # training, held out: keys, lengths and words

        def close() -> pa.RecordBatch:
            both = [*parts[0], *parts[1]]
            return _block(pid << 24 | n, sum(len(k) for k, _, _ in parts[0]), [k for keys, _, _ in both for k in keys], np.concatenate([m for _, m, _ in both]), pa.concat_arrays([w for _, _, w in both]))

        for batch in pieces(batches, 64):
            out = pc.fill_null(batch.column("held_out"), False)
            for part, own in zip(parts, (batch.filter(pc.invert(out)), batch.filter(out)), strict=True):
                if own.num_rows:
                    words, lengths = _split(own.column("text"))
                    part.append((own.column("key").to_pylist(), lengths, words))
                    size += len(words) + len(lengths)
            if size >= BLOCK:
                yield close()
                parts, size, n = ([], []), 0, n + 1
        if size:
            yield close()

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), held_out.alias("held_out")).mapInArrow(run, BLOCKS)


WORDS = "shard int, block bigint, words binary, counts binary"
ANSWER = "kind string, shard int, block bigint, a binary, b binary, c binary"
_ANSWER_NAMES = ["kind", "shard", "block", "a", "b", "c"]


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_ANSWER_NAMES)


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = unpack(r["words"], "<u8"), unpack_counts(r["counts"])
                order = np.argsort(words)
                words, counts = words[order], counts[order]
                cuts = np.searchsorted(shard_of(words, shards), np.arange(shards + 1))
                rows = [(s, r["block"], pack(words[a:b]), pack_counts(counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.binary()])], names=["shard", "block", "words", "counts"])

    return run


def _count_words(shards: int):
    """A shard of the vocabulary. Words get numbers from 1 by falling count, the same modulo for all of a shard."""

    def run(t: pa.Table) -> pa.Table:
        shard, rows = t.column("shard")[0].as_py(), t.to_pylist()
        asked = [unpack(r["words"], "<u8") for r in rows]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpack_counts(r["counts"]) for r in rows]), len(words)).astype(np.int64)
        numbers = np.empty(len(words), np.int64)
        numbers[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * shards + shard + 1
        out, begin = [], 0
        for r, own in zip(rows, asked, strict=True):
            mine = at[begin : begin + len(own)]
            begin += len(own)
            out.append(("answer", shard, r["block"], pack_counts(counts[mine]), pack_counts(numbers[mine]), None))
        out.append(("totals", shard, None, times_seen(counts).astype("<i8").tobytes(), np.array([counts.sum(), (counts > 0).sum()], "<i8").tobytes(), None))
        return _answers(out)

    return run


def steps(runs: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Numbers that rise within each run as differences; a run's first stays."""
    out = np.diff(numbers, prepend=0)
    first = (np.cumsum(runs) - runs)[runs > 0]
    out[first] = numbers[first]
    return out


def values(runs: np.ndarray, differences: np.ndarray) -> np.ndarray:
    """What steps() took differences of."""
    runs = runs[runs > 0]
    total, first = np.cumsum(differences), np.cumsum(runs) - runs
    return total - np.repeat(total[first] - differences[first], runs)


class Block:
    """A block with the vocabulary's answers."""

    def __init__(self, row: dict, answers: list[dict]):
        self.name, self.keys, self.learn = row["block"], row["keys"], row["learn"]
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.words, self.tokens = unpack(row["words"], "<u8"), unpack_counts(row["tokens"]).astype(np.int32)
        self.counts, self.numbers = (np.empty(len(self.words), np.int64) for _ in range(2))
        order = np.argsort(self.words)
        self.counts[order] = np.concatenate([unpack_counts(r["a"]) for r in answers])
        self.numbers[order] = np.concatenate([unpack_counts(r["b"]) for r in answers])
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths

    def ask(self, order: int, shards: int, most: int, begin: int, end: int) -> list[tuple]:
        """For each of the shards from begin to end its tokens by the word before, in the order of the text."""
        place = np.arange(len(self.tokens)) - np.repeat(self.first, self.lengths)
        at = np.flatnonzero(place >= 1)
        last = self.tokens[at - 1]
        parts = np.where(self.counts > most, self.counts * 2 // most, 1)
        owner = self.words[last]
        hot = np.flatnonzero(parts[last] > 1)
        if len(hot):
            by = self.tokens[at[hot]] if order == 2 else np.where(place[at[hot]] >= 2, self.tokens[at[hot] - 2], -1)
            deal = mix64(np.append(self.words, np.uint64(0)), 3)[by] % parts[last[hot]].astype(np.uint64)
            owner[hot] = mix64(owner[hot] + deal, 4)
        shard = shard_of(owner, shards)
        mine = (shard >= begin) & (shard < end)
        at, last, shard = at[mine], last[mine], shard[mine] - begin
        low = np.argsort(self.numbers)
        rank = np.empty(len(low), np.uint64)
        rank[low] = np.arange(len(low))
        # Shard, word and place sorted as one number: far below 2^64 (a block has some 2^20 tokens).
        wide = len(low).bit_length(), len(at).bit_length()
        code = np.sort(((shard.astype(np.uint64) << np.uint64(wide[0]) | rank[last]) << np.uint64(wide[1])) | np.arange(len(at), dtype=np.uint64))
        at = at[(code & np.uint64((1 << wide[1]) - 1)).astype(np.int64)]
        code >>= np.uint64(wide[1])
        cuts = np.searchsorted(code >> np.uint64(wide[0]), np.arange(end - begin + 1, dtype=np.uint64))
        before = [np.where(place[at] >= k, self.numbers[self.tokens[at - np.minimum(k, place[at])]], 0) for k in range(2, order)]
        word, number, out = self.tokens[at], self.numbers, []
        last = self.tokens[at - 1]
        for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), begin):
            if b > a:
                begins = np.flatnonzero(np.diff(code[a:b], prepend=code[a] + np.uint64(1)))
                runs = np.diff(begins, append=b - a)
                context = last[a:b][begins]
                held = np.zeros(len(number), bool)
                held[word[a:b]] = True
                words = low[held[low]]
                index = np.empty(len(number), np.int64)
                index[words] = np.arange(len(words))
                one = lambda x: pack_counts(steps(np.array([len(x)]), x))
                docs = self.doc[at[a:b]].astype(np.int64)
                out.append((s, self.name, self.learn, one(number[context]), pack_counts(runs), pack((parts[context] > 1).astype(np.uint8)), pack_counts(np.concatenate([x[a:b] for x in before]) if before else runs[:0]),
                            one(number[words]), pack_counts(self.counts[words]), pack_counts(index[word[a:b]]), pack_counts(steps(runs, docs))))
        return out


ASK = "shard int, block bigint, learn bigint, contexts binary, runs binary, hot binary, before binary, words binary, counts binary, next binary, docs binary"
_ASK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("learn", pa.int64()), *((x, pa.binary()) for x in ("contexts", "runs", "hot", "before", "words", "counts", "next", "docs"))])
KEPT = "kind string, shard int, last bigint, a binary, b binary, c binary"
_KEPT = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("last", pa.int64()), *((x, pa.binary()) for x in "abc")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers below 2^31 as one."""
    return high.astype(np.int64) << 32 | low


class Tokens:
    """The tokens of a shard: word (number) and count of it, last word before, further words before (0: none), document, and so on."""

    def __init__(self, t: pa.Table, order: int):
        runs = [unpack_counts(x.as_buffer()) for x in t.column("runs")]
        self.blocks, self.sizes = t.column("block").to_pylist(), np.array([x.sum() for x in runs])
        n = int(self.sizes.sum())
        self.last, self.word, self.doc = (np.empty(n, np.int32) for _ in range(3))
        self.before, self.count, self.hot, self.train = np.empty((order - 2, n), np.int32), np.empty(n, np.int64), np.empty(n, bool), np.empty(n, bool)
        one = lambda blob: np.cumsum(unpack_counts(blob))
        stop = 0
        for r, own in zip((x for b in t.to_batches(max_chunksize=1) for x in b.to_pylist()), runs, strict=True):
            at = slice(stop, stop := stop + int(own.sum()))
            self.last[at] = np.repeat(one(r["contexts"]), own)
            self.hot[at] = np.repeat(unpack(r["hot"], np.uint8).astype(bool), own)
            self.before[:, at] = unpack_counts(r["before"]).reshape(order - 2, -1) if order > 2 else 0
            index = unpack_counts(r["next"])
            self.word[at], self.count[at] = one(r["words"])[index], unpack_counts(r["counts"])[index]
            self.doc[at] = values(own, unpack_counts(r["docs"]))
            self.train[at] = self.doc[at] < r["learn"]

    @property
    def pair(self) -> np.ndarray:
        """Last word before and word as one number; numbers are below 2^31."""
        return _joined(self.last, self.word)


def _runs(x: np.ndarray) -> np.ndarray:
    """How often each distinct value occurs."""
    x = np.sort(x)
    return np.diff(np.flatnonzero(np.diff(x)), prepend=-1, append=len(x) - 1) if len(x) else np.zeros(0, np.int64)


def _count_grams(order: int, slices: int):
    """A shard's counts of counts; what was sent stays, as one row. What follows a word that is dealt out: rows by the word and slices of what follows."""

    def run(t: pa.Table) -> pa.Table:
        shard, own = t.column("shard")[0].as_py(), Tokens(t, order)
        at = np.flatnonzero(own.train)
        pair = own.pair
        totals = [times_seen(_runs(pair[at[~own.hot[at]]]))]
        h = pair[at].view(np.uint64)
        for before in own.before:
            some = before[at] > 0
            at, h = at[some], h[some]
            h = mix64(h) ^ mix64(before[at].astype(np.uint64), 1)
            totals.append(times_seen(_runs(h)))
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            kept = sink.getvalue().to_pybytes()
        out = [("work", shard, None, kept, None, None), ("totals", shard, None, np.concatenate(totals).astype("<i8").tobytes(), None, None)]
        hot = np.flatnonzero(own.hot & own.train)
        if len(hot):
            pairs, first, n = np.unique(pair[hot], return_index=True, return_counts=True)
            counts, slice_of = own.count[hot[first]], (pairs & 0xFFFFFFFF) % slices
            for last in np.unique(pairs >> 32).tolist():
                for x in range(slices):
                    at = np.flatnonzero((pairs >> 32 == last) & (slice_of == x))
                    if len(at):
                        out.append(("hot", x, last, pack_counts(pairs[at] & 0xFFFFFFFF), pack_counts(n[at]), pack_counts(counts[at])))
        return pa.Table.from_batches([_batch(out, _KEPT)])

    return run


def _add_hot(t: pa.Table) -> pa.Table:
    """The sums of a slice of what follows a word that is dealt out: word, times, and the word's own count."""
    word, n, count = (np.concatenate([unpack_counts(x) for x in t.column(c).to_pylist()]) for c in "abc")
    word, first, at = np.unique(word, return_index=True, return_inverse=True)
    n = np.bincount(at, n).astype(np.int64)
    blobs = [pack_counts(word), pack_counts(n), pack_counts(count[first]), times_seen(n).astype("<i8").tobytes()]
    return pa.table({"last": t.column("last")[:1], **{x: pa.array([b], pa.binary()) for x, b in zip(("word", "n", "count", "times"), blobs, strict=True)}})


def _add_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum((np.frombuffer(x, "<i8") for batch in batches for x in batch.column("times").to_pylist()), np.zeros(CUT + 2, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["times"])


def _numbered(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Small numbers for the values of x, and how many there are."""
    found = pa.array(x).dictionary_encode()
    out, n = found.indices.to_numpy().copy(), len(found.dictionary)
    del found
    pa.default_memory_pool().release_unused()
    return out, n


def _estimates(k: int, model: Model, context: np.ndarray, contexts: int, gram: np.ndarray, grams: int, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each token the estimate of order k: its context, its k-gram, how often the row was seen in training, and the estimate of order k - 1."""
    totals, a_row = np.bincount(gram, n, grams), np.empty(grams, np.int32)
    a_row[gram] = np.arange(len(gram), dtype=np.int32)
    some = np.flatnonzero(totals)
    own, a_row = totals[some], a_row[some]
    where, d = context[a_row], model.factors[k - 1][clipped(own).astype(np.int8)]
    total = np.bincount(where, own, contexts)
    weight, scale = model.weights(total, np.bincount(where, own * (1 - d), contexts), np.bincount(where, low[a_row], contexts))
    seen = np.zeros(grams)
    seen[some] = d * own / total[where] * scale[where]
    out = seen[gram]
    return np.where(out > 0, out, low * weight[context])


def _score_grams(order: int, model: Model, hot_path: str | None):
    """Sums of the logarithms of a shard's tokens by document: a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept in batch.column("a"):
                own = Tokens(pa.ipc.open_stream(kept.as_buffer()).read_all(), order)
                pair, last, count, n = own.pair, own.last, own.count, (own.train & ~own.hot).astype(np.float64)
                if own.hot.any():
                    fs, top = filesystem(hot_path)
                    more = pq.ParquetDataset(top, filesystem=fs, filters=[("last", "in", np.unique(last[own.hot]).tolist())]).read()
                    word, times, counts = (np.concatenate([unpack_counts(x) for x in more.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in ("word", "n", "count"))
                    after = np.repeat(more.column("last").to_numpy(), [len(unpack_counts(x)) for x in more.column("n").to_pylist()]).astype(np.int32)
                    pair, last = np.append(pair, _joined(after, word)), np.append(last, after)
                    count, n = np.append(count, counts), np.append(n, times)
                context, contexts = _numbered(last)
                gram, grams = _numbered(pair)
                p = _estimates(2, model, context, contexts, gram, grams, n, model.unigram(count))[: len(own.last)]
                at = np.arange(len(own.last), dtype=np.int32)
                del pair, last, count, n
                for k, before in enumerate(own.before, 3):
                    some = before[at] > 0
                    at = at[some]
                    context, contexts = _numbered(_joined(before[at], context[: len(some)][some]))
                    gram, grams = _numbered(_joined(before[at], gram[: len(some)][some]))
                    p[at] = _estimates(k, model, context, contexts, gram, grams, own.train[at].astype(np.float64), p[at])
                score, stops, out = np.log10(p), np.cumsum(own.sizes), []
                for block, a, b in zip(own.blocks, stops - own.sizes, stops, strict=True):
                    docs = np.flatnonzero(np.bincount(own.doc[a:b]))
                    out.append((block, pack_counts(steps(np.array([len(docs)]), docs)), pack(np.bincount(own.doc[a:b], score[a:b])[docs])))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.binary(), pa.binary()])], names=["block", "docs", "sums"])

    return run


def _add(t: pa.Table) -> pa.Table:
    """A block's sums over all shards, for the documents up to the last that has one."""
    docs = [np.cumsum(unpack_counts(x)) for x in t.column("docs").to_pylist()]
    sums = np.bincount(np.concatenate(docs), np.concatenate([unpack(x, "<f8") for x in t.column("sums").to_pylist()]))
    return pa.table({"bucket": t.column("bucket")[:1], "block": t.column("block")[:1], "shard": pa.array([0], pa.int32()), "a": pa.array([pack(sums)], pa.binary())})


class Katz:
    """Trains and scores in one go over a table of documents."""

    def __init__(self, scratch: Scratch, order: int = 2, hot: int = HOT):
        self.scratch, self.order, self.hot, self.model = scratch, order, hot, Model()

    def _vocabulary(self, cut: DataFrame, shards: int) -> None:
        """Counts and numbers of all words; the blocks' answers are sorted by block."""
        s = self.scratch
        path = s.path("words")
        cut.mapInArrow(_ask_words(shards), WORDS).groupBy("shard").applyInArrow(_count_words(shards), ANSWER).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        level = s.spark.read.parquet(path)
        s.release()
        store_answers(level.where("kind = 'answer'").drop("kind"), s.path("answers"), self.buckets)
        rows = level.where("kind = 'totals'").select("a", "b").collect()
        n, totals = (sum(np.frombuffer(r[i], "<i8") for r in rows) for i in range(2))
        self.model.unigrams(n, int(totals[0]), int(totals[1]))
        s.drop("words")
        s.release()

    def _grams(self, cut: DataFrame, shards: int) -> None:
        """Discounts of all orders from 2, and each block's sums of logarithms."""
        s, order, most, blocks_of = self.scratch, self.order, self.hot, self._blocks()

        path, slices = s.path("grams"), 1 + shards // 64
        cuts = [shards * n // ROUNDS for n in range(ROUNDS + 1)]
        for begin, end in pairwise(cuts):
            if begin == end:
                continue

            def ask(batches: Iterator[pa.RecordBatch], begin=begin, end=end) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for own in blocks_of(batch):
                        yield _batch(own.ask(order, shards, most, begin, end), _ASK)

            cut.mapInArrow(ask, ASK).groupBy("shard").applyInArrow(_count_grams(order, slices), KEPT).write.mode("append").partitionBy("kind").parquet(path)
            s.release()
        level = s.spark.read.schema(KEPT).parquet(path)
        rows = level.where("kind = 'totals'").select("a").collect()
        n = sum((np.frombuffer(r.a, "<i8") for r in rows), np.zeros((order - 1) * (CUT + 2), np.int64)).reshape(order - 1, -1)
        hot, hot_path = level.where("kind = 'hot'"), None
        if not hot.isEmpty():
            sums = hot.groupBy("last", "shard").applyInArrow(_add_hot, "last bigint, word binary, n binary, count binary, times binary")
            table, hot_path = s.write(sums, "hot"), s.path("hot")
            n[0] += sum(np.frombuffer(r.times, "<i8") for r in table.select("times").mapInArrow(_add_times, "times binary").collect())
        self.model.factors += [discounts(x) for x in n]
        sums = level.where("kind = 'work'").select("a").mapInArrow(_score_grams(order, self.model, hot_path), "block bigint, docs binary, sums binary")
        sums = sums.withColumn("bucket", bucket_of(self.buckets)).repartition(self.buckets, "bucket").groupBy("bucket", "block").applyInArrow(_add, "bucket int, block bigint, shard int, a binary")
        sums.write.partitionBy("bucket").option("compression", "zstd").parquet(s.path("sums"))
        s.drop("grams", "hot")
        s.release()

    def _blocks(self):
        """In a task: the blocks that come in, with the vocabulary's answers."""
        root = self.scratch.path("answers")
        return lambda batch: (Block(r, read_answers(root, r["bucket"], r["block"])) for r in batch.to_pylist())

    def fit_and_score(self, df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
        """For each row: key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
        s = self.scratch
        cut = s.write(blocks(df, held_out, key, text), "blocks")
        count = cut.count()
        self.buckets = max(1, -(-count // 4))
        cut = cut.withColumn("bucket", bucket_of(self.buckets))
        shards = max(1, count * BLOCK // SHARD_TOKENS)
        if count:
            self._vocabulary(cut, shards)
            if self.order > 1:
                self._grams(cut, shards)
        blocks_of, root, order, model = self._blocks(), s.path("sums"), self.order, self.model
        base = np.log10(model.tokens + 0.5 * (model.words + 1))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, bucket in zip(blocks_of(batch), batch.column("bucket").to_pylist(), strict=True):
                    n, c = len(own.lengths), own.counts[own.tokens]
                    add = lambda x, n=n, own=own: np.bincount(own.doc, x, n)
                    p = np.log10(model.unigram(own.counts))[own.tokens]
                    total = add(p) if order == 1 else p[own.first]
                    for r in read_answers(root, bucket, own.name) if order > 1 else []:
                        found = unpack(r["a"], "<f8")
                        total[: len(found)] += found
                    cols = [
                        pa.array(own.keys, pa.int64()), pa.array(np.arange(n) >= own.learn), pa.array(own.lengths), pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(n, model.tokens, np.int64)),
                        pa.array(add((np.log10(own.counts + 0.5) - base)[own.tokens])), pa.array(total),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        schema = "key bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
        return cut.mapInArrow(score, schema).withColumnRenamed("key", key)
