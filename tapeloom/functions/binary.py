"""Big-endian wire fields and 64-bit arithmetic as column expressions.

ANSI mode stays on: sums that wrap modulo 2^64 go through DECIMAL(38,0), rotations and xor work on BIGINT bit patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = "18446744073709551616"
TWO_63 = "9223372036854775808"


def unsigned(data: Column, at: int, size: int) -> Column:
    """The big-endian unsigned field data[at:at+size]; DECIMAL(20,0) for 8 bytes, else BIGINT."""
    text = F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10)
    return text.cast("decimal(20,0)") if size == 8 else text.cast("bigint")


def long(data: Column, at: int, size: int) -> Column:
    """As unsigned, but BIGINT: for values proven below 2^63."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("bigint")


def big_endian(value: Column, size: int) -> Column:
    """A non-negative number as size big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def little_endian(data: Column, at: int) -> Column:
    """The 8 bytes data[at:at+8] read as a little-endian bit pattern (BIGINT)."""
    swapped = F.concat(*(F.substring(F.hex(F.substring(data, at + 1 + k, 1)), 1, 2) for k in range(7, -1, -1)))
    return from_hex(swapped)


def from_hex(text: Column) -> Column:
    """16 hex digits as a BIGINT bit pattern."""
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(text, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def padded(text: Column | str, size: int) -> Column:
    """ASCII text, space padded to size bytes."""
    return F.encode(F.rpad(text, size, " "), "US-ASCII")


def rotate_left(x: Column, k: int) -> Column:
    k %= 64
    return x if k == 0 else F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))


def wrap(x: Column) -> Column:
    """A DECIMAL(38,0) modulo 2^64 as a BIGINT bit pattern."""
    m = F.pmod(x.cast("decimal(38,0)"), F.lit(TWO_64).cast("decimal(38,0)"))
    return F.when(m >= F.lit(TWO_63).cast("decimal(38,0)"), m - F.lit(TWO_64).cast("decimal(38,0)")).otherwise(m).cast("bigint")


_PIECE, _BITS = (1 << 22) - 1, 22


def sum_pieces(x: Column) -> list[Column]:
    """A BIGINT as three numbers whose own sums can't overflow; joined_pieces makes the sum modulo 2^64 of their sums."""
    return [x.bitwiseAND(_PIECE), F.shiftright(x, _BITS).bitwiseAND(_PIECE), F.shiftright(x, 2 * _BITS)]


def joined_pieces(low: Column, middle: Column, high: Column) -> Column:
    carried = middle + F.shiftright(low, _BITS)
    top = high + F.shiftright(carried, _BITS)
    return F.shiftleft(top, 2 * _BITS).bitwiseOR(F.shiftleft(carried.bitwiseAND(_PIECE), _BITS)).bitwiseOR(low.bitwiseAND(_PIECE))


def wrapping_sum(x: Column) -> Column:
    """Sum of BIGINTs modulo 2^64 (an aggregate)."""
    return joined_pieces(*map(F.sum, sum_pieces(x)))


def wrapping_times(a: Column, b: Column) -> Column:
    """Product of two BIGINTs below 2^63 modulo 2^64."""
    exact = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    return F.coalesce(F.try_multiply(a.cast("bigint"), b.cast("bigint")), wrap(exact))


def leading_zeros(x: Column) -> Column:
    return F.when(x == 0, 64).otherwise(64 - F.length(F.bin(x)))


def floor_quantum(t: Column, q: int) -> Column:
    return t - F.pmod(t, F.lit(q))
