"""Reading and writing the wire: frames to messages, tapes from files, and a Python data source for tapes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tapeloom.functions.binary import long, unsigned
from tapeloom.functions.itch import LENGTHS

HEADER, HEARTBEAT, END = 20, 0, 0xFFFF
TOP = 2**64 - 1


def header(frame: Column) -> dict[str, Column]:
    """session, seq, count and kind of a frame; last_seq is null where it passes 2^64 - 1."""
    seq, count = unsigned(frame, 10, 8), long(frame, 18, 2).cast("int")
    kind = F.when(count == HEARTBEAT, "heartbeat").when(count == END, "end").otherwise("data")
    last = seq.cast("decimal(38,0)") + count - 1
    fits = (kind == "data") & (last <= F.lit(str(TOP)).cast("decimal(38,0)"))
    return {"session": F.decode(F.substring(frame, 1, 10), "ISO-8859-1"), "seq": seq, "count": count, "kind": kind, "last_seq": F.when(fits, last.cast("decimal(20,0)"))}


def request(session: Column, start: Column, count: Column) -> Column:
    """A retransmission request."""
    from tapeloom.functions.binary import big_endian, padded

    return F.concat(padded(session, 10), big_endian(start, 8), big_endian(count, 2))


def message_error(msg: bytes) -> str | None:
    if not msg:
        return "Empty"
    known = LENGTHS.get(chr(msg[0]))
    return "UnknownType" if known is None else None if known == len(msg) else "LengthMismatch"


def parse(frame: bytes) -> tuple[str, int, str, str | None, list[bytes]]:
    """session, seq, kind, error and blocks of a frame. A packet counts entirely or not at all."""
    if len(frame) < HEADER:
        return "", 0, "data", "Truncated", []
    session = frame[:10].decode("latin-1")
    seq, count = struct.unpack(">QH", frame[10:HEADER])
    kind = "heartbeat" if count == HEARTBEAT else "end" if count == END else "data"
    if kind != "data":
        return session, seq, kind, "TrailingBytes" if len(frame) > HEADER else None, []
    if seq + count - 1 > TOP:
        return session, seq, kind, "SeqOverflow", []
    blocks, at = [], HEADER
    for _ in range(count):
        if at + 2 > len(frame) or at + 2 + (size := int.from_bytes(frame[at : at + 2], "big")) > len(frame):
            return session, seq, kind, "BlockOverrun", []
        blocks.append(frame[at + 2 : at + 2 + size])
        at += 2 + size
    if at != len(frame):
        return session, seq, kind, "TrailingBytes", []
    return session, seq, kind, next((e for e in map(message_error, blocks) if e), None), blocks


def parse_frames(frames: DataFrame) -> DataFrame:
    """frames (arrival, feed, frame) as packets: arrival, feed, session, seq, count, kind, error, blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(x or b"") for x in b.column("frame").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("arrival"), b.column("feed"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.decimal128(20, 0)),
                    pa.array([len(f[4]) for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.string()),
                    pa.array([[] if f[3] else f[4] for f in found], pa.list_(pa.binary())),
                ],
                names=["arrival", "feed", "session", "seq", "count", "kind", "error", "blocks"],
            )

    return frames.select("arrival", "feed", "frame").mapInArrow(run, "arrival bigint, feed int, session string, seq decimal(20,0), count int, kind string, error string, blocks array<binary>")


def parse_headers(frames: DataFrame) -> DataFrame:
    """frames (tape, arrival, feed, frame) as packets without their blocks: tape, arrival, feed, session, seq, count, kind, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(x or b"") for x in b.column("frame").to_pylist()]
            kinds = (pa.string(), pa.decimal128(20, 0), pa.string(), pa.string(), pa.int32())
            parts = zip(*((f[0], f[1], f[2], f[3], len(f[4])) for f in found), strict=True) if found else [[]] * 5
            session, seq, kind, error, count = (pa.array(list(x), t) for x, t in zip(parts, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("tape"), b.column("arrival"), b.column("feed"), session, seq, count, kind, error], names=["tape", "arrival", "feed", "session", "seq", "count", "kind", "error"])

    return frames.select("tape", "arrival", "feed", "frame").mapInArrow(run, "tape string, arrival bigint, feed int, session string, seq decimal(20,0), count int, kind string, error string")


def messages(packets: DataFrame) -> DataFrame:
    """One row for each message of valid data packets: arrival, feed, session, seq, msg."""
    rows = packets.where("kind = 'data' AND error IS NULL").select("arrival", "feed", "session", F.col("seq").cast("bigint").alias("first"), F.posexplode("blocks").alias("i", "msg"))
    return rows.select("arrival", "feed", "session", (F.col("first") + F.col("i")).alias("seq"), "msg")


def walk(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(message index, offset, message) of a tape of length-prefixed messages; a truncated tail ends it."""
    at = n = 0
    while at + 2 <= len(content):
        size = int.from_bytes(content[at : at + 2], "big")
        if at + 2 + size > len(content):
            return
        yield n, at, content[at + 2 : at + 2 + size]
        at, n = at + 2 + size, n + 1


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    """Messages of tape files through Spark's binary reader: file, msg_index, offset, msg."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(walk(content))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary())))], names=["file", "msg_index", "offset", "msg"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, msg_index bigint, offset bigint, msg binary")


def audit(tape: DataFrame, msg: str = "msg") -> DataFrame:
    """Messages by type with share in percent, violations counted by class."""
    from tapeloom.functions.itch import error_class, message_type

    m = F.col(msg)
    rows = tape.groupBy(message_type(m).alias("type"), error_class(m).alias("error")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return rows.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def report(histogram: DataFrame) -> DataFrame:
    """A histogram (type, n, basis_points; a row for each type) as numbered lines of text, the commonest type first, and a total."""
    from pyspark.sql import Window

    order = Window.orderBy(F.col("n").desc(), "type")
    rows = histogram.select(F.row_number().over(order).alias("line"), F.format_string("%s %12d %6.2f%%", "type", "n", F.col("basis_points") / 100).alias("text"))
    total = histogram.agg((F.count(F.lit(1)) + 1).cast("int").alias("line"), F.format_string("%d messages of %d types", F.sum("n"), F.count(F.lit(1))).alias("text"))
    return rows.unionByName(total)


class TapeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.value if "://" in partition.value else f"file://{partition.value}")
        with system.open_input_stream(path) as file:
            content = file.read()
        for index, offset, msg in walk(content):
            yield partition.value, index, offset, msg


class TapeSource(DataSource):
    """spark.dataSource.register(TapeSource); spark.read.format("tape").option("path", "a,b").load()"""

    @classmethod
    def name(cls) -> str:
        return "tape"

    def schema(self) -> str:
        return "file string, msg_index bigint, offset bigint, msg binary"

    def reader(self, schema) -> DataSourceReader:
        return TapeReader(self.options)
