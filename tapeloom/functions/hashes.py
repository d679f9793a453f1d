"""Checksums and ring arithmetic that SQL lacks, over numpy arrays and as Arrow UDFs."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the hash laws.
FNV_SEED, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN = 0x9E3779B97F4A7C15
RING_LOW = 0x1B  # x^64 = x^4 + x^3 + x + 1
SPAN_KEYS = (0x9E3779B97F4A7C15, 0xC9496682D48DB090, 0x0C29FAC027C1BE19, 0x27CAF68B98DA812D, 0xECC6D2FF80E61FD6)
MASK = (1 << 64) - 1


def _castagnoli() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


CRC_TABLE = _castagnoli()
_CRC = CRC_TABLE.tolist()


def crc_update(crc: int, data: bytes) -> int:
    """The raw CRC32C register after data; no inversion."""
    for b in data:
        crc = _CRC[(crc ^ b) & 255] ^ (crc >> 8)
    return crc


def crc32c(data: bytes) -> int:
    return crc_update(0xFFFFFFFF, data) ^ 0xFFFFFFFF


def fnv(h: int, data: bytes) -> int:
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & MASK
    return h


def rotl(x: int, k: int) -> int:
    k %= 64
    return ((x << k) | (x >> (64 - k))) & MASK


def fast_step(h: int, data: bytes) -> int:
    """One message of the fast hash: the register is seeded from the state."""
    crc = crc_update((h & 0xFFFFFFFF) ^ 0xFFFFFFFF, data) ^ 0xFFFFFFFF
    return rotl(h, 7) ^ ((crc * GOLDEN) & MASK)


def clmul(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
    return out


def reduce(x: int) -> int:
    while x >> 64:
        x = clmul(x >> 64, RING_LOW) ^ (x & MASK)
    return x


def mulmod(a: int, b: int) -> int:
    return reduce(clmul(a, b))


def mulmod_array(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ring products of two uint64 arrays."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    out, one, top = np.zeros_like(a), np.uint64(1), np.uint64(63)
    for k in range(64):
        out ^= a * (b >> np.uint64(k) & one)
        a = (a << one) ^ ((a >> top) * np.uint64(RING_LOW))
    return out


_SQUARES = [2]
for _ in range(63):
    _SQUARES.append(mulmod(_SQUARES[-1], _SQUARES[-1]))


def power_array(d: np.ndarray) -> np.ndarray:
    """x^d in the ring."""
    d = d.astype(np.uint64)
    out = np.ones(len(d), np.uint64)
    for k in range(int(d.max(initial=0)).bit_length()):
        bit = (d >> np.uint64(k) & np.uint64(1)) > 0
        if bit.any():
            out[bit] = mulmod_array(out[bit], np.full(bit.sum(), _SQUARES[k], np.uint64))
    return out


def power(d: int) -> int:
    return int(power_array(np.array([d], np.uint64))[0])


def span_lanes(body: bytes) -> int:
    """Eight interleaved CRC registers over 64-byte blocks, the tail in lane 0, combined with the length in the ring."""
    whole = len(body) // 64 * 64
    lanes = [crc_update(0, b"".join(body[i + 8 * k : i + 8 * k + 8] for i in range(0, whole, 64))) for k in range(8)]
    lanes[0] = crc_update(lanes[0], body[whole:])
    words = [lanes[2 * k] | lanes[2 * k + 1] << 32 for k in range(4)]
    acc = 0
    for term, key in zip([*words, len(body)], SPAN_KEYS, strict=True):
        acc ^= clmul(term, key)
    return reduce(acc)


def by_length(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length together: their places, and their bytes as a matrix."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([data[i] for i in at.tolist()]), np.uint8).reshape(len(at), size)


def _crc_columns(register: np.ndarray, columns: np.ndarray) -> np.ndarray:
    for column in columns.T:
        register = CRC_TABLE[(register ^ column) & np.uint32(255)] ^ (register >> np.uint32(8))
    return register


def crc_rows(data: list[bytes]) -> np.ndarray:
    """The raw registers after each row, from 0."""
    out = np.zeros(len(data), np.uint32)
    for at, rows in by_length(data):
        out[at] = _crc_columns(out[at], rows)
    return out


@functools.cache
def _byte_tables(key: int) -> np.ndarray:
    """Ring products with key, by byte of the other factor."""
    return np.array([[mulmod(b << 8 * k, key) for b in range(256)] for k in range(8)], np.uint64)


def times_key(a: np.ndarray, key: int) -> np.ndarray:
    tables, out = _byte_tables(key), np.zeros(len(a), np.uint64)
    for k in range(8):
        out ^= tables[k][(a >> np.uint64(8 * k)) & np.uint64(255)]
    return out


def span_lanes_rows(data: list[bytes]) -> np.ndarray:
    """span_lanes of each row."""
    out = np.zeros(len(data), np.uint64)
    for at, rows in by_length(data):
        n, size = rows.shape
        blocks = rows[:, : size // 64 * 64].reshape(n, -1, 8, 8)
        lanes = [_crc_columns(np.zeros(n, np.uint32), blocks[:, :, k].reshape(n, -1)) for k in range(8)]
        lanes[0] = _crc_columns(lanes[0], rows[:, size // 64 * 64 :])
        terms = [lanes[2 * k].astype(np.uint64) | lanes[2 * k + 1].astype(np.uint64) << np.uint64(32) for k in range(4)]
        for term, key in zip([*terms, np.full(n, size, np.uint64)], SPAN_KEYS, strict=True):
            out[at] ^= times_key(term, key)
    return out


@functools.cache
def _shift_tables(n: int) -> np.ndarray:
    """The raw register after n zero bytes, by byte of the register before (it is linear over bits)."""
    bits = [crc_shift(1 << k, n) for k in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8] ^= np.where(np.arange(256) >> (k % 8) & 1, np.uint32(bits[k]), np.uint32(0))
    return out


def crc_shift_array(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    distinct, at = np.unique(lengths, return_inverse=True)
    tables = np.stack([_shift_tables(int(n)) for n in distinct]) if len(distinct) else np.zeros((1, 4, 256), np.uint32)
    out = np.zeros(len(registers), np.uint32)
    for k in range(4):
        out ^= tables[at, k, (registers >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def crc_between_array(before: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc_between of each row."""
    return after ^ crc_shift_array(before, lengths)


def fnv_many(states: np.ndarray, streams: list[bytes]) -> np.ndarray:
    """FNV states after each stream; streams go on side by side, a byte of each at a time."""
    if len(streams) < 24:
        return np.array([fnv(int(h), data) for h, data in zip(states, streams, strict=True)], np.uint64)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    table = np.zeros((longest, len(streams)), np.uint64)
    for n, i in enumerate(order.tolist()):
        table[: sizes[i], n] = np.frombuffer(streams[i], np.uint8)
    h, live = states[order].copy(), np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    prime = np.uint64(FNV_PRIME)
    for k in range(longest):
        n = live[k]
        h[:n] = (h[:n] ^ table[k, :n]) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def fast_many(states: np.ndarray, counts: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Fast-hash states after each group's messages; data holds the groups one after another, counts their messages."""
    own, sizes = crc_rows(data), np.fromiter(map(len, data), np.int64, len(data))
    first, h = np.cumsum(counts) - counts, states.copy()
    ones, golden = np.uint32(0xFFFFFFFF), np.uint64(GOLDEN)
    for k in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > k)
        at, now = first[live] + k, h[live]
        seed = (now & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ ones
        crc = own[at] ^ crc_shift_array(seed, sizes[at]) ^ ones
        h[live] = (now << np.uint64(7) | now >> np.uint64(57)) ^ (crc.astype(np.uint64) * golden)
    return h


def signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


@F.pandas_udf(LongType())
def crc32c_udf(data: pd.Series) -> pd.Series:
    some = data.notna()
    rows = [bytes(b) for b in data[some]]
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    start = crc_shift_array(np.full(len(rows), 0xFFFFFFFF, np.uint32), np.fromiter(map(len, rows), np.int64, len(rows)))
    out[some] = (crc_rows(rows) ^ start ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return out


@F.pandas_udf(LongType())
def span_lanes_udf(data: pd.Series) -> pd.Series:
    return pd.Series(signed(span_lanes_rows([bytes(b) for b in data])))


@F.pandas_udf(LongType())
def wrapping_product(a: pd.Series, b: pd.Series) -> pd.Series:
    """a * b modulo 2^64, on bit patterns."""
    return pd.Series((a.to_numpy().view(np.uint64) * b.to_numpy().view(np.uint64)).view(np.int64))


@F.pandas_udf(LongType())
def ring_product(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(mulmod_array(a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(LongType())
def ring_power(d: pd.Series) -> pd.Series:
    return pd.Series(power_array(d.to_numpy(np.int64)).view(np.int64))


@F.pandas_udf(LongType())
def rotate_by(x: pd.Series, k: pd.Series) -> pd.Series:
    v, r = x.to_numpy(np.int64).view(np.uint64), (k.to_numpy(np.int64) % 64).astype(np.uint64)
    return pd.Series(((v << r) | np.where(r == 0, np.uint64(0), v >> ((np.uint64(64) - r) % np.uint64(64)))).view(np.int64))


def splitmix(state: int):
    """The generator's values, for ever."""
    while True:
        state = (state + GOLDEN) & MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        yield z ^ (z >> 31)


def crc_shift(crc: int, n: int) -> int:
    """The raw CRC32C register after n zero bytes."""
    return crc_update(crc, bytes(n)) if n < 64 else _crc_power(crc, n)


def _crc_power(crc: int, n: int) -> int:
    columns = [crc_update(1 << k, b"\0") for k in range(32)]  # the register is linear over bits
    while n:
        if n & 1:
            crc = _apply(columns, crc)
        columns = [_apply(columns, c) for c in columns]
        n >>= 1
    return crc


def _apply(columns: list[int], x: int) -> int:
    out, k = 0, 0
    while x:
        if x & 1:
            out ^= columns[k]
        x, k = x >> 1, k + 1
    return out


def crc_between(before: int, after: int, n: int) -> int:
    """The raw register of the n bytes between two cumulative registers that both started at 0."""
    return after ^ crc_shift(before, n)
