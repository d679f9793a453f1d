"""Gap recovery: requests for what is missing, a retransmission service as a join, and the loop that closes the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.arbitrate import missing_ranges

MOST, BUCKET, PAYLOAD, HEADER, PREFIX = 65_535, 1024, 1400, 20, 2
RETRIES = 4


def requests(missing: DataFrame) -> DataFrame:
    """Requests of at most MOST messages each: session_epoch, from_seq, count."""
    n = F.expr(f"(to_excl - from_seq - 1) div {MOST}")
    rows = missing.select("session_epoch", "from_seq", "to_excl", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("k"))
    start = F.col("from_seq") + F.col("k") * MOST
    return rows.select("session_epoch", start.alias("from_seq"), F.least(F.lit(MOST), F.col("to_excl") - start).cast("bigint").alias("count"))


#: Faults of the service, with how many requests or messages they concern (or how many nanoseconds of delay).
FAULTS = (("ok", 0), ("delay", 5_000_000), ("drop_request", 2), ("drop_response", 3), ("truncate", 1), ("truncate", 4), ("wrong_session", 0), ("duplicate_first", 0), ("unbound", 0))


def serve(asked: DataFrame, truth: DataFrame, fault: str = "ok", n: int = 0) -> DataFrame:
    """Messages that the service returns for requests: an interval join by buckets of the sequence.

    truth has session_epoch, seq and size. Faults: ok; delay (n nanoseconds late); drop_request and drop_response (the
    first n requests in order of their start get nothing, 0: none of them does); truncate (the first n messages of each, at
    least one); wrong_session (all is served under another session's name, so none of it is usable); duplicate_first;
    unbound (nobody answers). Sessions that truth lacks get nothing."""
    if fault == "unbound" or fault in ("drop_request", "drop_response") and not n:
        asked = asked.where("false")
    elif fault in ("drop_request", "drop_response"):
        first = asked.orderBy("session_epoch", "from_seq").limit(n).select("session_epoch", "from_seq")
        asked = asked.join(first, ["session_epoch", "from_seq"], "left_anti")
    end = F.col("from_seq") + F.col("count")
    spread = asked.withColumn("_b", F.explode(F.sequence(F.expr(f"from_seq div {BUCKET}"), F.expr(f"(from_seq + count - 1) div {BUCKET}"))))
    rows = truth.withColumn("_b", F.expr(f"seq div {BUCKET}")).join(spread, ["session_epoch", "_b"]).where((F.col("seq") >= F.col("from_seq")) & (F.col("seq") < end))
    rows = rows.select("session_epoch", "from_seq", "seq", "size", F.lit(n if fault == "delay" else 0).cast("bigint").alias("wait_ns"), F.lit(fault != "wrong_session").alias("usable"))
    if fault == "truncate":
        return rows.where(F.col("seq") < F.col("from_seq") + max(1, n))
    if fault == "duplicate_first":
        return rows.unionAll(rows.where("seq = from_seq"))
    return rows


def packed(served: DataFrame, size: int) -> DataFrame:
    """Served messages of one size as packets of at most PAYLOAD bytes: session_epoch, from_seq, first_seq, last_seq."""
    per = (PAYLOAD - HEADER) // (size + PREFIX)
    nth = F.expr(f"(seq - from_seq) div {per}")
    return served.groupBy("session_epoch", "from_seq", nth.alias("nth")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).drop("nth")


def recover(packets: DataFrame, truth: DataFrame, size: int = 12, rounds: int = RETRIES) -> tuple[DataFrame, bool]:
    """packets with what recovery delivered as feed 2 after all else, and whether gaps remain after the last round.

    Each round's packets are checkpointed, so that a round costs no earlier one again."""
    for _ in range(rounds):
        missing = missing_ranges(packets)
        if missing.isEmpty():
            return packets, False
        top = packets.agg(F.max("arrival").alias("top"))
        got = packed(serve(requests(missing), truth), size)
        got = got.crossJoin(F.broadcast(top))  # one row
        got = got.select(
            (F.col("top") + F.col("first_seq")).alias("arrival"), F.lit(2).alias("feed"), "session_epoch", "first_seq", "last_seq", (F.col("last_seq") - F.col("first_seq") + 1).cast("int").alias("count")
        )
        names = ["arrival", "feed", "session_epoch", "first_seq", "last_seq", "count"]
        packets = packets.select(*names).unionByName(got.select(*names)).checkpoint()
    return packets, not missing_ranges(packets).isEmpty()
