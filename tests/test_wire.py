"""Byte vectors, parsing and decoding."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import itch
from tapeloom.functions.binary import big_endian, floor_quantum, from_hex, leading_zeros, little_endian, rotate_left, unsigned, wrapping_sum
from tapeloom.sources import wire

SESSION = b"NFTESTSESS"
S1, S2 = b"S" + b"\0" * 10 + b"O", b"S" + b"\0" * 10 + b"C"
TV1 = SESSION + struct.pack(">QH", 1000, 2) + b"\0\x0c" + S1 + b"\0\x0c" + S2
TV2 = SESSION + struct.pack(">QH", 1002, 0)
TV3 = SESSION + struct.pack(">QH", 1002, 0xFFFF)
TV4 = SESSION + struct.pack(">QH", 990, 20)
EVENT = bytes.fromhex("53000000000A2DF4921D674F")


def test_frames():
    assert wire.parse(TV1) == ("NFTESTSESS", 1000, "data", None, [S1, S2])
    assert wire.parse(TV2)[1:4] == (1002, "heartbeat", None)
    assert wire.parse(TV3)[1:4] == (1002, "end", None)
    assert wire.parse(TV2 + b"x")[3] == "TrailingBytes" and wire.parse(TV1 + b"x")[3] == "TrailingBytes"
    assert wire.parse(TV1[:19])[3] == "Truncated" and wire.parse(TV1[:-1])[3] == "BlockOverrun"
    assert wire.parse(SESSION + struct.pack(">QH", 2**64 - 1, 2))[3] == "SeqOverflow"
    assert wire.parse(SESSION + struct.pack(">QH", 1, 1) + b"\0\0")[3] == "Empty"
    assert wire.parse(SESSION + struct.pack(">QH", 1, 1) + b"\0\1O")[3] == "UnknownType"
    assert wire.parse(SESSION + struct.pack(">QH", 1, 1) + b"\0\1S")[3] == "LengthMismatch"


def test_parser_never_raises():
    rnd = random.Random(0)
    for _ in range(5000):
        frame = bytearray(rnd.choice([TV1, TV2, TV3, TV4]))
        for _ in range(rnd.randrange(4)):
            frame[rnd.randrange(len(frame))] = rnd.randrange(256)
        wire.parse(bytes(frame[: rnd.randrange(len(frame) + 1)]))


def test_expressions_agree_with_the_parser(spark):
    rows = spark.createDataFrame([(i, 0, bytearray(f)) for i, f in enumerate([TV1, TV2, TV3, SESSION + struct.pack(">QH", 2**64 - 1, 2)])], "arrival bigint, feed int, frame binary")
    got = {r.arrival: r for r in rows.withColumns(wire.header(F.col("frame"))).collect()}
    assert (got[0].session, int(got[0].seq), got[0]["count"], got[0].kind, int(got[0].last_seq)) == ("NFTESTSESS", 1000, 2, "data", 1001)
    assert [got[i].kind for i in (1, 2)] == ["heartbeat", "end"] and got[3].last_seq is None
    parsed = wire.messages(wire.parse_frames(rows)).orderBy("seq").collect()
    assert [(r.seq, bytes(r.msg)) for r in parsed] == [(1000, S1), (1001, S2)]
    asked = rows.limit(1).select(wire.request(F.lit("NFTESTSESS"), F.lit(990), F.lit(20)).alias("x")).first().x
    assert bytes(asked) == TV4


def test_messages(spark):
    directory = b"R" + struct.pack(">HH", 1, 0) + (10**9).to_bytes(6, "big") + b"A       " + b"QN" + struct.pack(">I", 100) + b"N" + b"C" + b"Z " + b"P" + b"N" + b"N" + b"1" + b"N" + struct.pack(">I", 0) + b"N"
    upper, lower = b"H" + b"\0" * 24, b"h" + b"\0" * 20
    rows = spark.createDataFrame([(bytearray(m),) for m in (EVENT, directory, upper, lower, b"", b"O" + b"\0" * 47, EVENT[:-1])], "msg binary")
    assert [r[0] for r in rows.select(itch.error_class(F.col("msg"))).collect()] == [None, None, None, None, "Empty", "UnknownType", "LengthMismatch"]
    s = itch.decode(rows, "S").first()
    assert (s.event_code, s.ts_ns, s.locate) == ("O", 11192493022567, 0)
    r = itch.decode(rows, "R").first()
    assert (r.stock, r.round_lot_size, r.locate, r.issue_sub_type, r.inverse_indicator) == ("A", 100, 1, "Z", "N")


@pytest.mark.parametrize("kind", sorted(itch.FIELDS))
def test_encode_then_decode(spark, kind):
    values = {"locate": F.lit(7), "tracking": F.lit(3), "ts_ns": F.lit(2**47)}
    want = {}
    for i, (name, _, size, what) in enumerate(itch.FIELDS[kind]):
        want[name] = 2 ** (8 * size - 2) + i if what == "number" else "ABCDEFGH"[: max(1, size - 1)]
        values[name] = F.lit(want[name])
    rows = spark.range(1).select(itch.encode(kind, values).alias("msg"))
    got = itch.decode(rows, kind).first()
    assert got is not None and {n: got[n] for n in want} == want and (got.locate, got.tracking, got.ts_ns) == (7, 3, 2**47)


def test_binary_helpers(spark):
    x = -(2**63) + 12345
    rows = spark.createDataFrame([(bytearray(range(1, 9)), x)], "b binary, x bigint")
    got = rows.select(
        unsigned(F.col("b"), 0, 8).alias("u"), little_endian(F.col("b"), 0).alias("l"), rotate_left(F.col("x"), 13).alias("r"), leading_zeros(F.lit(1)).alias("z"), floor_quantum(F.lit(1234), 100).alias("q"),
        from_hex(F.lit("FFFFFFFFFFFFFFFE")).alias("h"), F.hex(big_endian(F.lit(258), 4)).alias("e"),
    ).first()
    u = x & (2**64 - 1)
    want = ((u << 13) | (u >> 51)) & (2**64 - 1)
    assert int(got.u) == 0x0102030405060708 and got.l == 0x0807060504030201 and got.r & (2**64 - 1) == want
    assert (got.z, got.q, got.h, got.e) == (63, 1200, -2, "00000102")
    big = spark.createDataFrame([(2**63 - 1,), (5,)], "x bigint").agg(wrapping_sum(F.col("x")).alias("s")).first().s
    assert big == -(2**63) + 4


def test_tapes(spark, tmp_path):
    content = b"".join(len(m).to_bytes(2, "big") + m for m in (EVENT, S1, b"", EVENT)) + b"\0\x09abc"
    (tmp_path / "a.tape").write_bytes(content)
    rows = sorted((r.msg_index, r.offset, bytes(r.msg)) for r in wire.read_tape(spark, f"file://{tmp_path}/a.tape").collect())
    assert [r[0] for r in rows] == [0, 1, 2, 3] and rows[2][2] == b""
    spark.dataSource.register(wire.TapeSource)
    again = spark.read.format("tape").option("path", f"{tmp_path}/a.tape").load()
    assert sorted((r.msg_index, r.offset, bytes(r.msg)) for r in again.collect()) == rows
    audit = {(r.type, r.error): r.n for r in wire.audit(again).collect()}
    assert audit == {("S", None): 3, ("", "Empty"): 1}
