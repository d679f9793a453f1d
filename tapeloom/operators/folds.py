"""Order-sensitive folds. Those with a closed form are XORs of independently placed terms; the rest run over one ordered group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tapeloom.functions import hashes as H
from tapeloom.functions.binary import little_endian, rotate_left
from tapeloom.functions.itch import SPAN_CLASS, SPAN_WEIGHT, lookup
from tapeloom.functions.ordering import running

ROTATE = 13


#: Bytes of messages that a task folds at once.
SLAB = 4 << 20


def sequential(messages: DataFrame, keys: list[str], order: str = "pos", msg: str = "msg") -> DataFrame:
    """golden (FNV-1a over length and bytes) and fast hash of each key's messages in order: a stream through one task for
    each key, since these folds don't decompose. A task folds many keys side by side, and carries the last one's state on."""
    fields = ", ".join(f"{k} {dict(messages.dtypes)[k]}" for k in keys)
    schema = to_arrow_schema(_parse_datatype_string(f"{fields}, n_messages bigint, golden bigint, fast bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple | None = None  # the key that is still open: key, n, golden, fast
        names: list[tuple] = []
        groups: list[list[bytes]] = []
        size = 0

        def fold(last: bool) -> pa.RecordBatch:
            nonlocal carried, names, groups, size
            if carried and (not names or names[0] != carried[0]):
                names, groups = [carried[0], *names], [[], *groups]
            golden = np.full(len(names), H.FNV_SEED, np.uint64)
            fast, n = golden.copy(), np.fromiter(map(len, groups), np.int64, len(groups))
            before = n.copy()
            if carried:
                golden[0], fast[0] = carried[2], carried[3]
                n[0] += carried[1]
            golden = H.fnv_many(golden, [b"".join(x for m in g for x in (len(m).to_bytes(2, "little"), m)) for g in groups])
            fast = H.fast_many(fast, before, [m for g in groups for m in g])
            done = len(names) if last else len(names) - 1
            carried = None if last or not names else (names[-1], int(n[-1]), golden[-1], fast[-1])
            cols = [pa.array([k[i] for k in names[:done]], schema.field(i).type) for i in range(len(keys))]
            cols += [pa.array(n[:done]), pa.array(H.signed(golden[:done])), pa.array(H.signed(fast[:done]))]
            names, groups, size = [], [], 0
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in batches:
            for *own, m in zip(*(b.column(k).to_pylist() for k in keys), b.column(msg).to_pylist(), strict=True):
                if not names or tuple(own) != names[-1]:
                    names.append(tuple(own))
                    groups.append([])
                groups[-1].append(m)
                size += len(m)
                if size >= SLAB:
                    yield fold(False)
        if names or carried:
            yield fold(True)

    rows = messages.select(*keys, order, msg).repartition(*keys).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(run, f"{fields}, n_messages bigint, golden bigint, fast bigint")


def rotate_fold(rows: DataFrame, value: str = "v", order: str = "pos", seed: int = H.FNV_SEED) -> DataFrame:
    """h = rotl(h, 13) ^ v * golden over all rows in order: each term rotated by how many follow it, then one XOR."""
    rows = running(rows, F.expr(f"{order} div 65536"), [order], _n=("sum", F.lit(1).cast("bigint")))
    total = rows.agg(F.max("_n").alias("_k"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    term = H.rotate_by(H.wrapping_product(F.col(value), F.lit(H.GOLDEN - (1 << 64))), (F.col("_k") - F.col("_n")) * ROTATE)
    start = H.rotate_by(F.lit(seed - (1 << 64)).cast("bigint"), F.col("k") * ROTATE)
    out = rows.select(term.alias("t"), "_k").agg(F.bit_xor("t").alias("x"), F.max("_k").alias("k"))
    return out.select(F.col("k").alias("n"), F.col("x").bitwiseXOR(start).alias("fold"))


def payload(msg: Column, kind: Column) -> Column:
    """First and last eight bytes of a message with its type on top; 0 for messages below 16 bytes."""
    last = F.expr("substring(msg, length(msg) - 7, 8)")
    top = F.shiftleft(F.ascii(kind).cast("bigint"), 56)
    mixed = little_endian(msg, 0).bitwiseXOR(rotate_left(little_endian(last, 0), 29)).bitwiseXOR(top)
    return F.when(F.length(msg) < 16, F.lit(0)).otherwise(mixed).cast("bigint")


def ring_terms(messages: DataFrame) -> DataFrame:
    """Messages (pos, type, msg) plus class, weight and payload value."""
    kind = F.col("type")
    return messages.withColumns({"ty": lookup(SPAN_CLASS, kind, 9), "w": lookup(SPAN_WEIGHT, kind, 0).cast("bigint"), "v": payload(F.col("msg"), kind)})


def ring_fold(terms: DataFrame, *by: str) -> DataFrame:
    """V = xor of v * x^(weights after it) within each key: the ordered product as suffix sums and one XOR."""
    keys = list(by)
    rows = running(terms, F.expr("pos div 65536"), ["pos"], keys, _w=("sum", F.col("w")))
    total = terms.groupBy(*keys).agg(F.sum("w").cast("bigint").alias("deg"))
    rows = rows.join(total, keys) if keys else rows.crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("_t", H.ring_product(F.col("v"), H.ring_power((F.col("deg") - F.col("_w")).cast("bigint"))))
    return rows.groupBy(*keys).agg(F.bit_xor("_t").alias("v"), F.max("deg").alias("deg"), F.count(F.lit(1)).alias("cnt")).withColumn("c", H.ring_power("deg"))


def compose(early: tuple[int, int], late: tuple[int, int]) -> tuple[int, int]:
    """Two adjacent records (value, degree) as one."""
    return H.mulmod(early[0], H.power(late[1])) ^ late[0], early[1] + late[1]


def composed(records: DataFrame, *by: str) -> DataFrame:
    """Records (pos, v, deg, cnt) of each key, in order of pos, as one: v, deg, cnt and c = x^deg."""
    keys = list(by)
    after = Window.partitionBy(*keys).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)  # records are few: one a chunk or window
    rows = records.withColumn("_after", F.coalesce(F.sum("deg").over(after), F.lit(0)).cast("bigint"))
    rows = rows.withColumn("_t", H.ring_product(F.col("v"), H.ring_power(F.col("_after"))))
    return rows.groupBy(*keys).agg(F.bit_xor("_t").alias("v"), F.sum("deg").cast("bigint").alias("deg"), F.sum("cnt").cast("bigint").alias("cnt")).withColumn("c", H.ring_power("deg"))


def chain_in_order(windows: DataFrame, slot: str = "slot") -> DataFrame:
    """The same as chain, window by window: what a chain is held against."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = 0
        for own in pdf.sort_values("window")["hash"]:
            h = H.mulmod(h, H.power(64)) ^ (int(own) & H.MASK)
        return pd.DataFrame({slot: [pdf[slot].iloc[0]], "ordered": H.signed([h])})

    return windows.select(slot, "window", "hash").groupBy(slot).applyInPandas(run, f"{slot} {dict(windows.dtypes)[slot]}, ordered bigint")


def crc_parts(messages: DataFrame, keys: list[str], order: str = "pos", msg: str = "msg") -> DataFrame:
    """Raw registers of messages by subtraction: a key's cumulative registers run through one task, and each message's own is
    what lies between two of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, register = None, 0
        for b in batches:
            before, after = [], []
            for *own, m in zip(*(b.column(k).to_pylist() for k in keys), b.column(msg).to_pylist(), strict=True):
                if own != key:
                    key, register = own, 0
                before.append(register)
                register = H.crc_update(register, m)
                after.append(register)
            lengths = pc.binary_length(b.column(msg)).to_numpy(zero_copy_only=False).astype(np.int64)
            crc = H.crc_between_array(np.array(before, np.uint32), np.array(after, np.uint32), lengths)
            yield pa.RecordBatch.from_arrays([b.column(order), pa.array(crc.astype(np.int64))], names=["pos", "crc"])

    rows = messages.select(*keys, order, msg).repartition(*keys).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(run, "pos bigint, crc bigint")


def chain(windows: DataFrame, slot: str = "slot") -> DataFrame:
    """Each slot's windows in order: chain * x^64 xor hash, by the same closed form with weight 64 each."""
    return ring_fold(windows.select(slot, F.col("window").alias("pos"), F.col("hash").alias("v"), F.lit(64).cast("bigint").alias("w")), slot).select(slot, F.col("v").alias("chain"), F.col("cnt").alias("windows"))


def affine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered product of affine maps x -> m x + b on 4 words modulo 2^64: rows have pos, m (16 numbers) and b (4 numbers)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        m, b = np.eye(4, dtype=np.uint64), np.zeros(4, np.uint64)
        for own, add in zip(pdf["m"], pdf["b"], strict=True):
            a = np.asarray(own, np.int64).view(np.uint64).reshape(4, 4)
            m, b = a @ m, a @ b + np.asarray(add, np.int64).view(np.uint64)
        return pd.DataFrame([[*pdf[keys].iloc[0], m.ravel().view(np.int64).tolist(), b.view(np.int64).tolist()]], columns=[*keys, "m", "b"])

    fields = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{fields}, m array<bigint>, b array<bigint>")
