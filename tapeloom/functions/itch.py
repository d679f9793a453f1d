"""The message catalogue: lengths, field layouts, validation and decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.binary import big_endian, long, padded

# Fixed values of the wire format: message lengths by type.
LENGTHS = {
    "S": 12, "R": 39, "H": 25, "Y": 20, "L": 26, "V": 35, "W": 12, "K": 28, "J": 35, "h": 21, "A": 36,
    "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40, "B": 19, "I": 50, "N": 20,
}
# Fixed values of the wire format: fields beyond the common header, as (name, first byte, bytes, kind).
FIELDS = {
    "S": [("event_code", 11, 1, "text")],
    "R": [
        ("stock", 11, 8, "text"), ("market_category", 19, 1, "text"), ("financial_status", 20, 1, "text"), ("round_lot_size", 21, 4, "number"),
        ("round_lots_only", 25, 1, "text"), ("issue_classification", 26, 1, "text"), ("issue_sub_type", 27, 2, "text"), ("authenticity", 29, 1, "text"),
        ("short_sale_threshold", 30, 1, "text"), ("ipo_flag", 31, 1, "text"), ("luld_tier", 32, 1, "text"), ("etp_flag", 33, 1, "text"),
        ("etp_leverage", 34, 4, "number"), ("inverse_indicator", 38, 1, "text"),
    ],
    "A": [("order_ref", 11, 8, "number"), ("side", 19, 1, "text"), ("shares", 20, 4, "number"), ("stock", 24, 8, "text"), ("price", 32, 4, "number")],
    "F": [("order_ref", 11, 8, "number"), ("side", 19, 1, "text"), ("shares", 20, 4, "number"), ("stock", 24, 8, "text"), ("price", 32, 4, "number"), ("mpid", 36, 4, "text")],
    "E": [("order_ref", 11, 8, "number"), ("shares", 19, 4, "number"), ("match_number", 23, 8, "number")],
    "C": [("order_ref", 11, 8, "number"), ("shares", 19, 4, "number"), ("match_number", 23, 8, "number"), ("printable", 31, 1, "text"), ("price", 32, 4, "number")],
    "X": [("order_ref", 11, 8, "number"), ("shares", 19, 4, "number")],
    "D": [("order_ref", 11, 8, "number")],
    "U": [("order_ref", 11, 8, "number"), ("new_ref", 19, 8, "number"), ("shares", 27, 4, "number"), ("price", 31, 4, "number")],
}
# Fixed values of the span hash: classes and weights (44-byte P weighs 43 here).
SPAN_CLASS = {"A": 0, "F": 1, "E": 2, "C": 3, "X": 4, "D": 5, "U": 6, "P": 7, "Q": 8}
SPAN_WEIGHT = {"A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 43, "Q": 40}


def lookup(table: dict, key: Column, default=None) -> Column:
    pairs = F.create_map(*(F.lit(x) for item in table.items() for x in item))
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def message_type(msg: Column) -> Column:
    return F.decode(F.substring(msg, 1, 1), "ISO-8859-1")


def error_class(msg: Column) -> Column:
    """Empty, UnknownType or LengthMismatch, the first that holds; null for a valid message."""
    known = lookup(LENGTHS, message_type(msg))
    return F.when(F.length(msg) == 0, "Empty").when(known.isNull(), "UnknownType").when(F.length(msg) != known, "LengthMismatch")


def header(msg: Column) -> dict[str, Column]:
    return {"type": message_type(msg), "locate": long(msg, 1, 2).cast("int"), "tracking": long(msg, 3, 2).cast("int"), "ts_ns": long(msg, 5, 6)}


def body(msg: Column, kind: str) -> dict[str, Column]:
    out = {}
    for name, at, size, what in FIELDS[kind]:
        out[name] = long(msg, at, size) if what == "number" else F.rtrim(F.decode(F.substring(msg, at + 1, size), "US-ASCII"))
    return out


def decode(df: DataFrame, kind: str, msg: str = "msg") -> DataFrame:
    """df's valid messages of one type, with header and body columns."""
    m = F.col(msg)
    rows = df.where(error_class(m).isNull() & (message_type(m) == kind))
    return rows.withColumns(header(m) | body(m, kind))


def encode(kind: str, values: dict[str, Column]) -> Column:
    """A message from columns: locate, tracking, ts_ns and the type's fields; bytes without a field are spaces."""
    parts = [padded(F.lit(kind), 1), big_endian(values["locate"], 2), big_endian(values.get("tracking", F.lit(0)), 2), big_endian(values["ts_ns"], 6)]
    at = 11
    for name, begin, size, what in FIELDS.get(kind, []):
        if begin > at:
            parts.append(padded(F.lit(""), begin - at))
        value = values.get(name, F.lit(0) if what == "number" else F.lit(""))
        parts.append(big_endian(value, size) if what == "number" else padded(value, size))
        at = begin + size
    if at < LENGTHS[kind]:
        parts.append(padded(F.lit(""), LENGTHS[kind] - at))
    return F.concat(*parts)


def book_columns(df: DataFrame, msg: str = "msg") -> DataFrame:
    """Messages (pos, msg) as the order book's relation: pos, type, locate, order_ref, new_ref, side, q, px, printable."""
    m, kind = F.col(msg), F.col("type")

    def field(name: str) -> Column:
        out = None
        for t, fields in FIELDS.items():
            for own, at, size, what in fields:
                if own == name and t in "AFECXDU":
                    value = long(m, at, size) if what == "number" else F.rtrim(F.decode(F.substring(m, at + 1, size), "US-ASCII"))
                    out = F.when(kind == t, value) if out is None else out.when(kind == t, value)
        return out

    rows = df.withColumns({"type": message_type(m), "locate": long(m, 1, 2).cast("int")})
    return rows.select("pos", "type", "locate", *(field(n).alias(a) for n, a in (("order_ref", "order_ref"), ("new_ref", "new_ref"), ("side", "side"), ("shares", "q"), ("price", "px"), ("printable", "printable"))))
