"""Two producers' journals as one: merge by end position, batch totals before a batch, overlap of a range with one lane's batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.ordering import numbered, running


def merged(even: DataFrame, odd: DataFrame, bucket: int = 65_536) -> DataFrame:
    """Both lanes' spans (end, first_seq, count) in order of their end: lane, position and all columns."""
    rows = even.withColumn("lane", F.lit(0)).unionByName(odd.withColumn("lane", F.lit(1)))
    return numbered(rows, F.expr(f"`end` div {bucket}"), ["end", "lane"], "position")


def totals_before(batches: DataFrame, bucket: int = 4096) -> DataFrame:
    """batches (batch, spans, messages) plus spans_before and messages_before."""
    rows = running(batches, F.expr(f"batch div {bucket}"), ["batch"], inclusive=False, spans_before=("sum", F.col("spans")), messages_before=("sum", F.col("messages")))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("spans_before", "messages_before")})


def overlap(batches: DataFrame, start: int, stop: int) -> DataFrame:
    """How many spans of the batches lie in the global span range [start, stop)."""
    rows = totals_before(batches)
    inside = F.greatest(F.lit(0), F.least(F.lit(stop), F.col("spans_before") + F.col("spans")) - F.greatest(F.lit(start), F.col("spans_before")))
    return rows.agg(F.coalesce(F.sum(inside), F.lit(0)).cast("bigint").alias("spans"))


def first_messages(tape: DataFrame, n: int) -> DataFrame:
    """The first n messages: a filter on the index, which reaches the scan."""
    return tape.where(F.col("msg_index") < n)


def valid_prefix(blocks_valid: str = "valid"):
    """Length of the longest prefix of an array of booleans that holds no false."""
    at = F.array_position(blocks_valid, False)
    return F.when(at > 0, at - 1).otherwise(F.size(blocks_valid)).cast("int")
