"""SimHash near-dedup through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 bytes. Postings are keyed by the
values of three byte positions at once; 20 position triples suffice for every 4 of 8 positions to hold one (Turan's
system), so every pair that can qualify meets under some key. Under a key the bytes shared by position are tallied for
each pair, pairs with the guaranteed 4 are kept, and their differing bits verified.

Copies are one class: only distinct fingerprints are linked. A posting list gives a spanning forest of its links (members
to the first of their kind), never all pairs. Lists longer than LIST are dealt anew by a fourth byte position, which
every qualifying pair must share too; lists still longer are compared in blocks, each pair of blocks in a task of its
own. Nothing is capped.

Defined results: a null text is the empty text; texts without words have fingerprint zero, linked like any other; texts
with fewer words than a shingle are one shingle; very long texts are read whole; rows repeated under a key stay rows of
their own; null keys never are a component's name (a component of null keys only has none); an empty table gives no rows;
other columns, also those named like results, play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tapeloom.llm.common import LOWER_TABLE, Scratch, in_tasks, mix64, pieces, shuffle_partitions, utf8
from tapeloom.llm.graph import components

BITS, SHARED, LIST, BLOCK = 4, 4, 2048, 1024
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: All triples inside a group, or with two positions in a group and one in the next.
TRIPLES = [t for t in combinations(range(8), 3) if any(set(t) <= set(g) for g in _GROUPS) or any(len(set(t) & set(g)) == 2 and len(set(t) & set(_GROUPS[(i + 1) % 3])) == 1 for i, g in enumerate(_GROUPS))]


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    own = text.translate(LOWER_TABLE).split()
    if not own:
        return 0
    flat = b" ".join(own)
    if len(own) <= words:
        return xxh64_intdigest(flat, seed)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = [0, *ends[: len(own) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts, stops, strict=True)], ">u8")
    return int.from_bytes(np.packbits(2 * set_bits(h) > len(h)).tobytes(), "big")


def set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the big-endian 64-bit values h have each bit set."""
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        out += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """key and fp (the fingerprint's 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t, words, seed) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found.view(np.int64))], names=["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key bigint, fp bigint")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a (m) qualify with which of b (n): tally shared positional bytes, keep pairs with enough, verify bits."""
    x = a[:, None] ^ b[None, :]
    tally = (x.view(np.uint8).reshape(len(a), len(b), 8) == 0).sum(2, dtype=np.uint8)
    out = tally >= SHARED
    out[out] = np.bitwise_count(x[out]) <= BITS
    return out


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the qualifying pairs of a posting list connect."""
    near = np.concatenate([_near(fps[i : i + 128], fps) for i in range(0, len(fps), 128)])
    left, out = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if left[root]:
            front = np.zeros(len(fps), bool)
            front[root] = True
            while front.any():
                left &= ~front
                front = near[front].any(0) & left
                out += [(root, int(i)) for i in np.flatnonzero(front)]
    return out


EDGES = "a bigint, b bigint, list bigint"  # a link, or (list set) a member b of a list that is too long here


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, fp) sorted by list. Lists cut by a batch's end go on in the next one."""
    none = np.zeros(0, np.int64)
    key, fps, long = None, none, None

    def batch(a, b, lists=None):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(lists if lists is not None else [None] * len(a), pa.int64())], names=["a", "b", "list"])

    def close(own: np.ndarray):
        if len(own) > 1:
            found = forest(own.view(np.uint64))
            if found:
                i = np.array(found)
                yield batch(own[i[:, 0]], own[i[:, 1]])

    for t in batches:
        lists, values = t.column("list").to_numpy(), t.column("fp").to_numpy()
        cuts = np.flatnonzero(np.diff(lists)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(lists)]])
        if not len(lists):
            continue
        # Lists of one that begin and end inside the batch need no look.
        some = np.flatnonzero((stops - starts > 1) | (starts == 0) | (stops == len(lists)))
        for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True):
            if lists[a] != key:
                yield from close(fps)
                key, fps, long = int(lists[a]), none, False
            fps = np.concatenate([fps, values[a:b]])
            if long or len(fps) > LIST:
                long = True
                yield batch(fps, fps, np.full(len(fps), key))
                fps = none
    yield from close(fps)


def _index(fps: DataFrame, blocks: list[tuple[int, ...]]) -> DataFrame:
    """list (a number for block and byte values) and fp: one posting for each block of byte positions."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    keys = []
    for n, block in enumerate(blocks):
        key = F.lit(n).cast("bigint")
        for p in block:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("list"), "fp")


def _linked(fps: DataFrame, blocks: list[tuple[int, ...]], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    postings = in_tasks(_index(fps, blocks).repartition("list"), fps.count() * len(blocks))
    found = scratch.write(postings.sortWithinPartitions("list", "fp").mapInArrow(_lists, EDGES), name)
    return found.where("list IS NULL").select("a", "b"), found.where("list IS NOT NULL").select("list", F.col("b").alias("fp"))


def _blocks(long: DataFrame) -> DataFrame:
    """Links within lists too long for a task: pairs of blocks of BLOCK members, each pair a group."""
    sizes = long.groupBy("list").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("n"))
    rows = long.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, n - 1)"))).select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def pairs(t: pa.Table) -> pa.Table:
        own = np.unique(t.column("fp").to_numpy())
        found = np.array(forest(own.view(np.uint64)), np.int64).reshape(-1, 2)
        return pa.table({"a": own[found[:, 0]], "b": own[found[:, 1]]})

    return rows.groupBy("list", "i", "j").applyInArrow(pairs, "a bigint, b bigint")


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) among the distinct fingerprints fp, enough to connect all that qualifying pairs connect."""
    edges, long = _linked(fps, TRIPLES, scratch, "triples")
    if not long.isEmpty():
        # Members of a long list share three positions; qualifying pairs share a fourth one.
        more, longer = _linked(long.select("fp").distinct(), list(combinations(range(8), 4)), scratch, "quads")
        edges = edges.unionAll(more)
        if not longer.isEmpty():
            edges = edges.unionAll(_blocks(longer))
    return edges.where("a != b")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """key, fp and component_id (the smallest key of the near-duplicate component) for each row of df."""
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.write(fingerprints(df, key, text, words, seed), "fingerprints")
    distinct = scratch.write(in_tasks(rows.groupBy("fp").agg(F.min("key").alias("least")), rows.count()), "classes")
    named = _named(distinct, links(distinct.select("fp"), scratch), scratch)
    return in_tasks(rows.join(named, "fp"), rows.count()).select(F.col("key").alias(key), "fp", "component_id")


def _named(distinct: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """fp and component_id of each class (fp, least), from links between fps."""
    found, rows = components(edges, scratch), distinct.count()
    labelled = in_tasks(distinct.join(found, F.col("fp") == F.col("node"), "left"), rows).select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = in_tasks(labelled.groupBy("root").agg(F.min("least").alias("component_id")), rows)
    return scratch.write(in_tasks(labelled.join(names, "root"), rows).select("fp", "component_id"), "named")


# --- Similar texts ------------------------------------------------------------------------------------------------
#
# Texts of a similarity of 0.8 differ in 15 % of their fingerprint bits, far more than 4 of 64, so their fingerprint is LANES SimHashes side
# by side, over the same kind of index: two texts that may qualify share SHARES of its byte positions or more. The positions are
# dealt to SHARES - 1 teams, so two of the shared ones are in one team, and every such pair of texts meets under the values of two
# positions of a team. A posting list is keyed by the first of them and cut into runs by the second inside its task. In a run the
# differing bits of two lanes are counted, then the shared bytes of all positions (the count filter) and all differing bits.
# A byte agrees with probability (1 - 0.1515) ** 8 = 0.27 at similarity 0.8: a pair of that similarity shares fewer than SHARES of the
# 96 with probability 4e-8 (1e-4 for the sets that fare worst, 4 shingles of 5), and less above; the two limits of bits lose less.
#
# The index only says which texts to compare. Candidates connected in any way are a cluster; inside it the shingle sets
# themselves are compared, all pairs that are not connected already, and only a Jaccard similarity that is reached is a link.
# Texts of equal sets are one class.

LANES, SHARES = 12, 6
POSITIONS = 8 * LANES
_LANE = np.random.default_rng(96).integers(0, 2**64, (LANES, 1), np.uint64)
TEAMS = np.array_split(np.arange(POSITIONS), SHARES - 1)
#: Differing bits of the first two lanes and of all, at most: five deviations beyond what the worst sets of similarity 0.8 have.
TWO_BITS, ALL_BITS = 48, 210
#: Members of a run whose pairs are all looked at; pairs looked at in one go.
RUN, PAIRS = 512, 1 << 18
#: Bytes of shingle sets in a block of a cluster, about (BLOCK members at most).
SET_BYTES = 4 << 20
#: Classes for each bucket of posting lists; buckets at least.
BUCKET_PRINTS, LEAST_BUCKETS = 1 << 14, 12
#: Keys that are broadcast at most; more are joined by shuffles.
BROADCAST_KEYS = 1 << 21


def wide_fingerprint(h: np.ndarray) -> bytes:
    """LANES SimHashes of a set of shingles that is not empty."""
    counts = np.zeros((LANES, 64), np.int64)
    for at in range(0, len(h), 255):
        bits = np.unpackbits(mix64(h[at : at + 255] ^ _LANE).astype(">u8").view(np.uint8)).reshape(LANES, -1, 64)
        counts += np.add.reduce(bits, axis=1, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).tobytes()


def _wide_near(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (i, j) of fps (n, LANES) qualify."""
    some = np.flatnonzero(np.bitwise_count(fps[i, 0] ^ fps[j, 0]) + np.bitwise_count(fps[i, 1] ^ fps[j, 1]) <= TWO_BITS)
    x = fps[i[some]] ^ fps[j[some]]
    tally = (x.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(1)
    out = np.zeros(len(i), bool)
    out[some[(tally >= SHARES) & (np.bitwise_count(x).sum(1, dtype=np.int64) <= ALL_BITS)]] = True
    return out


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives what the pairs connect the same label, the least position in it."""
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        np.minimum.at(label, high, low)
        while not np.array_equal(again := label[label], label):
            label[:] = again
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]


def _long_run(fps: np.ndarray, label: np.ndarray, run: np.ndarray) -> None:
    """Connects the members of a run; those with one label go together and are not compared with each other."""
    while len(run):
        front = run[:1]
        while len(front):
            mine = label[run] == label[front[0]]
            front, run = run[mine], run[~mine]
            found = np.zeros(len(run), bool)
            for i in front.tolist():
                rest = np.flatnonzero(~found)
                if not len(rest):
                    break
                found[rest[_wide_near(fps, np.full(len(rest), i), run[rest])]] = True
            met = run[found]
            _unite(label, np.full(len(met), front[0]), met)
            front = met[:1]


def qualifying(fps: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """A label for each fingerprint (n, LANES) of a list: equal for those connected by qualifying pairs that share one of the second positions."""
    own, label = fps.view(np.uint8).reshape(-1, POSITIONS), np.arange(len(fps))
    for second in seconds.tolist():
        order = np.argsort(own[:, second], kind="stable")
        lengths = np.bincount(own[:, second], minlength=256)
        lengths, stops = lengths[lengths > 0], np.cumsum(lengths[lengths > 0])
        for n in np.flatnonzero(lengths > RUN).tolist():
            _long_run(fps, label, order[stops[n] - lengths[n] : stops[n]])
        after = np.repeat(np.where(lengths > RUN, 0, stops), lengths) - np.arange(len(fps)) - 1  # members of the run that follow
        after = np.maximum(after, 0)
        cuts = np.searchsorted(np.cumsum(after), np.arange(PAIRS, int(after.sum()) + PAIRS, PAIRS)) + 1
        for a, b in pairwise([0, *cuts.tolist()]):
            at = np.arange(a, min(b, len(fps)))
            i, j = order[np.repeat(at, after[at])], order[_ranges(at + 1, after[at])]
            apart = np.flatnonzero(label[i] != label[j])
            i, j = i[apart], j[apart]
            near = _wide_near(fps, i, j)
            _unite(label, i[near], j[near])
    return label


def _position_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, node, print) sorted by list: links that connect what a list's qualifying pairs connect."""
    key, nodes, prints = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        own = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        if len(own) > 1:
            first = key >> 8
            team = next(t for t in TEAMS if first in t)
            label = qualifying(np.frombuffer(b"".join(prints), np.uint64).reshape(-1, LANES), team[team > first])
            some = np.flatnonzero(label != np.arange(len(label)))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(own[label[some]]), pa.array(own[some])], names=["a", "b"])

    for t in batches:
        lists, own, values = t.column("list").to_numpy(), t.column("node").to_numpy(), t.column("print").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)] if len(lists) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if lists[a] != key:
                yield from close()
                key, nodes, prints = int(lists[a]), [], []
            nodes.append(own[a:b])
            prints += values[a:b]
    yield from close()


def _packed(prints: np.ndarray, nodes: np.ndarray, team: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """The postings of a team's positions but the last, in a row for each bucket of lists: lists, whose they are, and each node and print once."""
    lists = (prints[:, team[:-1]] + (team[:-1] << 8)).astype(np.int32).ravel()
    at = np.repeat(np.arange(len(prints)), len(team) - 1)
    bucket = (mix64(lists.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    stops = np.cumsum(np.bincount(bucket, minlength=buckets))
    for own in np.split(order, stops[:-1]):
        if len(own):
            some, index = np.unique(at[own], return_inverse=True)
            yield int(bucket[own[0]]), lists[own].tobytes(), index.astype(np.uint16).tobytes(), nodes[some].tobytes(), prints[some].tobytes()


def _unpacked(rows: Iterator[tuple[bytes, bytes, bytes, bytes]], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows (list, node, print) sorted by list, of what _packed() gave."""
    lists, at, nodes, prints, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], [], 0
    for own, index, node, found in rows:
        lists.append(np.frombuffer(own, np.int32))
        at.append(np.frombuffer(index, np.uint16) + np.int64(n))
        nodes.append(node)
        prints.append(found)
        n += len(node) // 8
    lists, at, nodes, prints = np.concatenate(lists), np.concatenate(at), np.frombuffer(b"".join(nodes), np.int64), np.frombuffer(b"".join(prints), f"V{POSITIONS}")
    order = np.argsort(lists, kind="stable")
    for a in range(0, len(order), size):
        some = order[a : a + size]
        yield pa.RecordBatch.from_arrays([pa.array(lists[some]), pa.array(nodes[at[some]]), pa.array(prints[at[some]].tolist(), pa.binary())], names=["list", "node", "print"])


def _buckets(classes: int, partitions: int) -> int:
    return min(max(partitions, 1), max(LEAST_BUCKETS, -(-classes // BUCKET_PRINTS)))


def _candidates(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the classes (fp, prints) that connect all qualifying pairs; one team of positions at a time, so that its postings alone are on disk.

    A batch's prints go once to each bucket of lists, not once for each list, so buckets are as few as a task's memory allows."""
    found, buckets = [], _buckets(distinct.count(), shuffle_partitions(scratch.spark))
    names = ["bucket", "lists", "at", "nodes", "prints"]
    for n, team in enumerate(TEAMS):

        def postings(batches: Iterator[pa.RecordBatch], team=team) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 2048):
                prints = np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.uint8).reshape(-1, POSITIONS)
                rows = list(_packed(prints, batch.column("fp").to_numpy(), team, buckets))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate([pa.int32(), *[pa.binary()] * 4])], names=names)

        def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _position_links(_unpacked(tuple(x) for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in names[1:]), strict=True)))

        posted = distinct.where("prints IS NOT NULL").select("fp", "prints").mapInArrow(postings, "bucket int, lists binary, at binary, nodes binary, prints binary")
        found.append(scratch.write(posted.repartitionById(buckets, F.col("bucket")).mapInArrow(links, "a bigint, b bigint"), f"candidates-{n}"))
        scratch.release()
    return functools.reduce(DataFrame.unionAll, found)


# Keys of ROWS least hashes each agree with probability similarity ** ROWS. Nothing here uses them; a test holds them to that.

ROWS, BANDS = 6, 48
_FLIP, _TIMES = np.random.default_rng(68).integers(0, 2**64, (2, ROWS * BANDS, 1), np.uint64)
_TIMES |= np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles that is not empty."""
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, ((h[None, at : at + 1024] ^ _FLIP) * _TIMES).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for own in least.reshape(ROWS, BANDS):
        key = mix64(key ^ own)
    return key.view(np.int64)


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    own = text.translate(LOWER_TABLE).split()
    if not own:
        return np.zeros(0, np.uint64)
    flat = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    n = max(1, len(own) - words + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[min(words, len(own)) - 1 :] - 1).tolist()
    return np.unique(np.array([xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64))


def set_name(h: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    return int(np.uint64(xxh64_intdigest(h.astype("<u8").tobytes())).view(np.int64))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Links (pairs of positions) that connect what the pairs of sets of this Jaccard similarity or more connect.

    Sets of that similarity share at least similarity * size members of each, so they share one among the size - that + 1
    rarest of each. Only sets that meet in these are compared: a passage that all of them hold brings no pair together."""
    sizes = np.array([len(h) for h in sets], np.int64)
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner, starts = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    rarity = np.empty(len(words), np.int64)
    rarity[np.argsort(np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words))
    flat = rarity[flat]
    flat = flat[np.lexsort((flat, owner))]
    rare = np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)  # the little less errs towards more
    at = _ranges(starts, rare)
    order = np.argsort(flat[at], kind="stable")
    holders, held = owner[at][order], np.concatenate([[0], np.cumsum(np.bincount(flat[at], minlength=len(words)))])
    left, marked, out = np.ones(len(sets), bool), np.zeros(len(words), bool), []
    for root in range(len(sets)):
        front = [root] if left[root] else []
        left[root] = False
        while front:
            i = front.pop()
            own = flat[starts[i] : starts[i] + sizes[i]]
            first = own[: rare[i]]
            met = holders[_ranges(held[first], held[first + 1] - held[first])]
            met = np.unique(met[left[met]])
            met = met[(sizes[met] >= similarity * sizes[i] - 1e-9) & (sizes[i] >= similarity * sizes[met] - 1e-9)]
            if not len(met):
                continue
            marked[own] = True
            shared = np.add.reduceat(marked[flat[_ranges(starts[met], sizes[met])]].astype(np.int64), np.cumsum(sizes[met]) - sizes[met])
            marked[own] = False
            found = met[shared / (sizes[i] + sizes[met] - shared) >= similarity].tolist()
            out += [(i, j) for j in found]
            left[found] = False
            front += found
    return np.array(out, np.int64).reshape(-1, 2)


def _sent(keys: DataFrame) -> DataFrame:
    """keys, a written table's, broadcast if they are few; each row is some 8 bytes."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _blocked(clusters: DataFrame) -> DataFrame:
    """clusters (node, root, least, members: of the node's set) plus n: clusters too large for a task are n blocks, and each pair of blocks a group."""
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("members") * 8 / SET_BYTES)).cast("int")
    return clusters.join(clusters.groupBy("root").agg(F.greatest(n, F.lit(1)).alias("n")), "root")


def _alike_in(clusters: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect what the pairs of the similarity or more connect in each cluster (node, root, n, least: a key of the node's texts).

    A set goes from its text straight to its groups: it is shuffled once for each, and by the group, not the cluster."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(t, words) for t in utf8(batch.column("text"))]
            # Another text under the same key is another class.
            own = [n for n, (h, node) in enumerate(zip(sets, batch.column("node").to_pylist(), strict=True)) if set_name(h) == node]
            some = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("node"), some.column("root"), some.column("n"), pa.array([sets[n].astype("<u8").tobytes() for n in own], pa.binary())], names=["node", "root", "n", "set"])

    # Most texts are in no cluster: they are left where they are, and only the others are shuffled, if any.
    asked = clusters.select(F.xxhash64("least").alias("_asked"))
    docs = docs.join(_sent(asked), F.xxhash64("key") == F.col("_asked"), "left_semi") if clusters.count() <= BROADCAST_KEYS else docs
    met = docs.join(clusters, F.col("key").eqNullSafe(F.col("least"))).select("text", "node", "root", "n")
    rows = met.mapInArrow(sets_of, "node bigint, root bigint, n int, set binary").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, n - 1)"))).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "set")

    def pairs(t: pa.Table) -> pa.Table:
        nodes, first = np.unique(t.column("node").to_numpy(), return_index=True)  # rows repeated under a key give a node again
        found = alike([np.frombuffer(x, "<u8") for x in t.column("set").take(pa.array(first)).to_pylist()], similarity)
        return pa.table({"a": nodes[found[:, 0]], "b": nodes[found[:, 1]]})

    return rows.groupBy("root", "i", "j").applyInArrow(pairs, "a bigint, b bigint")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """key and component_id for each row of df: texts connected by pairs whose shingle sets have the similarity or more.

    Null, empty and blank texts have the empty set and are one class, like no other; else results are defined as above."""
    scratch = Scratch(df.sparkSession, "simhash")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(t, words) for t in utf8(batch.column("text"))]
            prints = [wide_fingerprint(h) if len(h) else None for h in sets]
            columns = [batch.column("key"), pa.array(map(set_name, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "members", "prints"])

    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = scratch.write(docs.mapInArrow(keyed, "key bigint, fp bigint, members bigint, prints binary"), "keyed")
    distinct = rows.groupBy("fp").agg(F.min("key").alias("least"), F.any_value("members").alias("members"), F.any_value("prints").alias("prints"))
    distinct = scratch.write(distinct, "classes")
    near = components(_candidates(distinct, scratch), scratch, "near").join(distinct.select(F.col("fp").alias("node"), "least", "members"), "node")
    clusters = scratch.write(in_tasks(_blocked(scratch.write(in_tasks(near, distinct.count()), "nodes")), distinct.count()), "clusters")
    alike = scratch.write(_alike_in(clusters, docs, words, similarity), "alike")
    scratch.release()
    named = _named(distinct.select("fp", "least"), alike, scratch)
    return rows.join(named, "fp").select(F.col("key").alias(key), "component_id")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df that stay, with df's columns: those that name their component of similar texts. Rows that repeat the
    naming key stay together; of a component of null keys only, the rows stay; an empty table stays empty."""
    named = similar_groups(df, key, text, words, similarity)
    # Those that go are fewer than those that stay: they are broadcast up to BROADCAST_KEYS, and no text is shuffled.
    gone = named.groupBy(F.col(key).alias("_key")).agg(F.bool_or(F.col(key).eqNullSafe(F.col("component_id"))).alias("_stay")).where("NOT _stay").select("_key")
    gone = _sent(Scratch(df.sparkSession, "simhash-gone").write(gone, "gone"))
    return df.join(gone, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
