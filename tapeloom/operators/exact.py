"""Arbitration that is exact for every tape: the closed form where it holds, the sequencer for all other tapes.

The closed form (operators.arbitrate) holds for a tape of one session whose frames are all whole data packets and none of
which reaches past the reorder window. Which tapes those are is settled by data, not by a setting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import arbitrate as A
from tapeloom.sources import wire
from tapeloom.streaming import sequencer


def split(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the tapes that the closed form serves: their packets with watermarks and what is emitted (session_epoch is the tape).
    And the names of all other tapes. All are checkpointed."""
    packets = wire.parse_headers(frames).checkpoint()
    plain = packets.groupBy("tape").agg(F.countDistinct("session").alias("sessions"), F.bool_and((F.col("kind") == "data") & F.col("error").isNull()).alias("whole")).checkpoint()
    rows = packets.join(plain.where("whole AND sessions = 1").select("tape"), "tape", "left_semi")
    rows = rows.select(F.col("tape").alias("session_epoch"), "arrival", "feed", F.col("seq").cast("bigint").alias("first_seq"), "count", (F.col("seq").cast("bigint") + F.col("count") - 1).alias("last_seq")).checkpoint()
    out = A.emitted(rows).checkpoint()
    marked = A.watermarks(rows, out).checkpoint()
    beyond = A.beyond_window(marked).select(F.col("session_epoch").alias("tape")).distinct()
    others = plain.where("NOT whole OR sessions > 1").select("tape").unionByName(beyond).checkpoint()
    past = others.withColumnRenamed("tape", "session_epoch")
    return marked.join(past, "session_epoch", "left_anti"), out.join(past, "session_epoch", "left_anti"), others


def emitted(frames: DataFrame) -> DataFrame:
    """frames (tape, arrival, feed, vt, frame) as emitted messages: tape, seq, arrival, gen. Needs a checkpoint folder."""
    marked, out, others = split(frames)
    closed = A.eras(out, A.gap_events(marked).checkpoint()).select(F.col("session_epoch").alias("tape"), "seq", F.col("emit_arrival").alias("arrival"), "gen")
    rows = sequencer.arbitrate(frames.join(others, "tape", "left_semi")).where("event = 'Message'")
    return closed.unionByName(rows.select("tape", F.col("a").alias("seq"), "arrival", "gen"))
