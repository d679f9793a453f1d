"""Multi-venue operators: slots by hash of the locate, window digests that need no order, publications and triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.binary import TWO_64, floor_quantum, rotate_left, wrapping_sum
from tapeloom.functions.hashes import GOLDEN

SLOTS, DRIFT, DEPTH, WINDOW = 8, 10_000, 16, 512


def slot(locate: Column, slots: int = SLOTS) -> Column:
    """((locate * golden) mod 2^64 >> 24) mod slots; the product of 16 and 64 bits fits a DECIMAL(38,0)."""
    product = F.pmod(locate.cast("decimal(10,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)"), F.lit(TWO_64).cast("decimal(20,0)"))
    return F.pmod(F.floor(product.cast("decimal(38,0)") / F.lit(1 << 24)).cast("decimal(38,0)"), F.lit(slots)).cast("int")


def digest(rows: DataFrame, *by) -> DataFrame:
    """(xor v, xor c, sums of db, da, deg, cnt): any order and any grouping of the rows gives the same."""
    sums = [wrapping_sum(F.col(c)).alias(c) for c in ("db", "da", "deg", "cnt")]
    return rows.groupBy(*by).agg(F.bit_xor("v").alias("v"), F.bit_xor("c").alias("c"), *sums)


def digest_hash() -> Column:
    """The hash of a digest row's six columns; its rotations are fixed values."""
    out = F.col("v").bitwiseXOR(rotate_left(F.col("c"), 17)).bitwiseXOR(rotate_left(F.col("db"), 31)).bitwiseXOR(rotate_left(F.col("da"), 47))
    return out.bitwiseXOR(F.shiftleft("deg", 32)).bitwiseXOR(F.col("cnt"))


def window_records(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Book tokens as slot records: slot, window, v, c, db, da, deg, cnt. v and c are SQL-expressible stand-ins of a span record."""
    return tokens.select(
        slot(F.col("locate")).alias("slot"), F.expr(f"(pos - 1) div {window}").alias("window"),
        (F.col("pos") * 2654435761).bitwiseXOR(F.col("px")).alias("v"), (F.col("pos") * 40503 + F.col("locate")).alias("c"), "db", "da", F.length("type").cast("bigint").alias("deg"), F.lit(1).cast("bigint").alias("cnt"),
    )


def span_records(messages: DataFrame, window: int = WINDOW) -> DataFrame:
    """Messages (pos, locate, msg) as span records of the real hash: v the lane CRC of the body, c = x^bytes in the ring."""
    from tapeloom.functions.hashes import ring_power, span_lanes_udf

    size = F.length("msg").cast("bigint")
    return messages.select(slot(F.col("locate")).alias("slot"), F.expr(f"(pos - 1) div {window}").alias("window"), "pos", span_lanes_udf("msg").alias("v"), ring_power(size).alias("c"), F.lit(0).cast("bigint").alias("db"), F.lit(0).cast("bigint").alias("da"), size.alias("deg"), F.lit(1).cast("bigint").alias("cnt"))


def merged_windows(records: DataFrame) -> DataFrame:
    """Per window: messages, the digest's hash, and the digest."""
    return digest(records, "window").withColumn("hash", digest_hash())


def project(tag: Column) -> Column:
    """The tagged projections of a record (v, c, deg, cnt)."""
    v, c = F.col("v"), F.col("c")
    return (
        F.when(tag == 0, v).when(tag == 1, F.shiftrightunsigned(v, 32).bitwiseXOR(c)).when(tag == 2, v.bitwiseAND(0xFFFFFFFF).bitwiseOR(F.shiftleft("deg", 32))).when(tag == 3, F.col("cnt")).otherwise(v.bitwiseXOR(c))
    )


def cone(distance: Column | None = None) -> Column:
    """Distance between slot and reader in nanoseconds, as a matrix would hold it."""
    return F.abs(F.col("slot") - F.col("reader")) * 1_000 if distance is None else distance


def trigger_reads(triggers: DataFrame, pubs: DataFrame, tag: int = 0) -> DataFrame:
    """Triggers with what the window they pin holds: read, base_ns (null where it isn't published)."""
    held = pubs.select(F.col("slot").alias("_s"), F.col("window").alias("_w"), project(F.lit(tag)).alias("read"), F.col("pub_ns").alias("base_ns"))
    return triggers.join(held, (F.col("slot") == F.col("_s")) & (F.col("w_prime") == F.col("_w")), "left").drop("_s", "_w")


def verdicts(reads: DataFrame, quantum: int = 1_000) -> DataFrame:
    """Why each trigger is refused, if it is: stale, early, fabricated, deep; and the two widened bounds."""
    bound = F.greatest(F.lit(0), F.col("base_ns") + cone() - DRIFT)
    why = (
        F.when(F.col("base_ns").isNull(), "stale").when(F.col("arrival_ns") < bound, "early").when(F.col("claim") != F.col("read"), "fabricated").when(F.col("depth") > DEPTH, "deep").otherwise("ok")
    )
    claim, held, d = floor_quantum(F.col("arrival_ns"), quantum), floor_quantum(F.col("base_ns"), quantum), cone()
    return reads.withColumns({"verdict": why, "legal": claim + DRIFT + quantum >= held + d, "legal_full": claim + DRIFT + 2 * quantum >= held + floor_quantum(d, quantum)})
