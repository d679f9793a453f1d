"""Dual-feed arbitration as window and aggregate steps (no state machine), and the per-packet annotations that follow from it.

Inputs are delivered data packets (arrival, feed, session_epoch, first_seq, last_seq, and optional heartbeats). Content
is a function of the delivered set; when a message goes out is the running maximum of first arrivals in sequence order.
Running values go over buckets of the order (functions.ordering), so one session may be larger than a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.ordering import BUCKET, running
from tapeloom.sources.derived import messages_of

WINDOW = 1024


def data(packets: DataFrame) -> DataFrame:
    """packets without heartbeats (rows with beat set, whose first_seq is the next number they announce)."""
    return packets.where("NOT beat") if "beat" in packets.columns else packets


def with_heartbeats(packets: DataFrame, beats: DataFrame) -> DataFrame:
    """Data packets and heartbeats (arrival, feed, session_epoch, next_seq) as one relation: only gap evidence comes from beats."""
    rows = beats.select("arrival", "feed", "session_epoch", F.col("next_seq").alias("first_seq"), (F.col("next_seq") - 1).alias("last_seq"), F.lit(0).alias("count"), F.lit(True).alias("beat"))
    return packets.select("arrival", "feed", "session_epoch", "first_seq", "last_seq", "count", F.lit(False).alias("beat")).unionByName(rows)


def epochs(packets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """packets plus session_epoch: how many times the session had changed by then."""
    order = Window.orderBy("arrival").partitionBy("_b")
    rows = packets.withColumn("_b", F.expr(f"arrival div {bucket}"))
    last = rows.groupBy("_b").agg(F.max_by("session", "arrival").alias("_last"))
    last = last.select((F.col("_b") + 1).alias("_b"), "_last")
    rows = rows.join(last, "_b", "left").withColumn("_before", F.coalesce(F.lag("session").over(order), F.col("_last")))
    rows = rows.withColumn("_change", (F.col("_before").isNotNull() & (F.col("_before") != F.col("session"))).cast("int"))
    rows = running(rows.drop("_b", "_last", "_before"), F.expr(f"arrival div {bucket}"), ["arrival"], session_epoch=("sum", F.col("_change")))
    return rows.withColumn("session_epoch", F.col("session_epoch").cast("int")).drop("_change")


def first_arrivals(packets: DataFrame) -> DataFrame:
    """session_epoch, seq, first_arrival: the union of the feeds without duplicates, the first received copy counts."""
    rows = messages_of(data(packets), "session_epoch", "arrival")
    return rows.groupBy("session_epoch", "seq").agg(F.min("arrival").alias("first_arrival"))


def anchors(packets: DataFrame) -> DataFrame:
    """session_epoch, anchor: the first sequence number of the session's first data packet."""
    return data(packets).groupBy("session_epoch").agg(F.min_by("first_seq", "arrival").alias("anchor"))


def emitted(packets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The contiguous prefix from the anchor: session_epoch, seq, first_arrival, emit_arrival, staged."""
    rows = first_arrivals(packets).join(anchors(packets), "session_epoch").where("seq >= anchor")
    b = F.expr(f"seq div {bucket}")
    rows = running(rows, b, ["seq"], ["session_epoch"], _n=("sum", F.lit(1).cast("bigint")), emit_arrival=("max", F.col("first_arrival")))
    rows = rows.where(F.col("seq") - F.col("_n") == F.col("anchor") - 1)
    return rows.select("session_epoch", "seq", "first_arrival", "emit_arrival", (F.col("emit_arrival") > F.col("first_arrival")).alias("staged"))


def first_copies(parsed: DataFrame) -> DataFrame:
    """Messages that go out of one session's parsed frames (wire.parse_frames): seq and msg, the first copy received of each.

    Packets that lie below the watermark when they arrive are dropped before their messages are looked at."""
    whole = parsed.where("kind = 'data' AND error IS NULL").select("arrival", "feed", F.lit(0).alias("session_epoch"), F.col("seq").cast("bigint").alias("first_seq"), F.size("blocks").alias("count"), "blocks")
    packets = whole.select("arrival", "feed", "session_epoch", "first_seq", "count", (F.col("first_seq") + F.col("count") - 1).alias("last_seq"))
    out = emitted(packets).select("seq", F.col("first_arrival").alias("arrival"))
    rows = whole.select("arrival", "first_seq", F.posexplode("blocks").alias("i", "msg")).select("arrival", (F.col("first_seq") + F.col("i")).alias("seq"), "msg")
    return rows.join(out, ["arrival", "seq"]).select("seq", "msg")


def watermarks(packets: DataFrame, out: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """packets plus w_before and w_after, the next expected number around each packet (w_before null for the first)."""
    out = emitted(packets) if out is None else out
    steps = out.groupBy("session_epoch", F.col("emit_arrival").alias("arrival")).agg(F.count(F.lit(1)).alias("_n"))
    rows = packets.join(steps, ["session_epoch", "arrival"], "left").join(anchors(packets), "session_epoch")
    rows = running(rows, F.expr(f"arrival div {bucket}"), ["arrival"], ["session_epoch"], _sum=("sum", F.coalesce("_n", F.lit(0))), _first=("min", F.when(~F.col("beat"), F.col("arrival")) if "beat" in packets.columns else F.col("arrival")))
    after = F.col("anchor") + F.col("_sum")
    rows = rows.withColumns({"w_after": after, "w_before": F.when(F.col("_first") < F.col("arrival"), after - F.coalesce("_n", F.lit(0)))})
    return rows.drop("_n", "_sum", "_first", "anchor")


def classes(marked: DataFrame) -> DataFrame:
    """Watermarked packets plus class (duplicate, contiguous, ahead) and dup_msgs."""
    marked, w = data(marked), F.coalesce("w_before", "first_seq")
    kind = F.when(F.col("last_seq") < w, "duplicate").when(F.col("first_seq") <= w, "contiguous").otherwise("ahead")
    dup = F.when(kind == "duplicate", F.col("count")).when(kind == "contiguous", w - F.col("first_seq")).otherwise(0)
    return marked.withColumns({"class": kind, "dup_msgs": dup.cast("bigint")})


def gap_events(marked: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """GapOpened and ReAnchored events: session_epoch, arrival, event, at (the watermark), ahead, gen (within the session)."""
    x = F.when(F.col("first_seq") > F.coalesce("w_before", "first_seq"), F.col("first_seq"))
    b = F.expr(f"arrival div {bucket}")
    rows = running(marked.withColumn("_x", x), b, ["arrival"], ["session_epoch"], inclusive=False, _e0=("max", F.col("_x")))
    e0, w0 = F.coalesce("_e0", F.lit(0)), F.coalesce("w_before", F.lit(0))
    e = F.greatest(e0, F.coalesce("_x", F.lit(0)))
    opened, closed = (w0 >= e0) & (F.col("w_after") < e), (w0 < e0) & (F.col("w_after") >= e)
    rows = rows.withColumn("event", F.when(opened, "GapOpened").when(closed, "ReAnchored"))
    rows = running(rows, b, ["arrival"], ["session_epoch"], gen=("sum", F.when(F.col("event") == "GapOpened", 1).otherwise(0).cast("bigint")))
    rows = rows.where("event IS NOT NULL")
    return rows.select("session_epoch", "arrival", "event", F.col("w_after").alias("at"), F.when(F.col("event") == "GapOpened", F.col("_x")).alias("ahead"), "gen")


def eras(out: DataFrame, events: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Emitted messages plus gen: how many gaps had opened when they went out."""
    opens = events.where("event = 'GapOpened'").select("session_epoch", F.col("arrival").alias("emit_arrival"), F.lit(None).cast("bigint").alias("seq"), F.lit(1).alias("_open"))
    rows = out.withColumn("_open", F.lit(0)).unionByName(opens, allowMissingColumns=True)
    rows = running(rows, F.expr(f"emit_arrival div {bucket}"), ["emit_arrival", F.col("_open").desc(), "seq"], ["session_epoch"], gen=("sum", F.col("_open").cast("bigint")))
    return rows.where("seq IS NOT NULL").drop("_open")


def missing_ranges(packets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Holes below the highest delivered number: session_epoch, from_seq, to_excl. Islands, without a generated series."""
    seen = first_arrivals(packets).join(anchors(packets), "session_epoch").where("seq >= anchor")
    last = running(seen, F.expr(f"seq div {bucket}"), ["seq"], ["session_epoch"], inclusive=False, _last=("max", F.col("seq")))
    rows = last.withColumn("_last", F.coalesce("_last", F.col("anchor") - 1)).where(F.col("seq") > F.col("_last") + 1)
    return rows.select("session_epoch", (F.col("_last") + 1).alias("from_seq"), F.col("seq").alias("to_excl"))


def counters(marked: DataFrame, out: DataFrame, events: DataFrame) -> DataFrame:
    """One row of telemetry. It holds where beyond_window is 0; sequencer.telemetry counts exactly for any tape."""
    side = lambda f: F.col("feed") % 2 == f
    per = marked.agg(
        *(F.count_if(side(f)).alias(f"packets_{n}") for f, n in ((0, "a"), (1, "b"))),
        *(F.count_if(side(f) & (F.col("class") == "duplicate")).alias(f"dups_{n}") for f, n in ((0, "a"), (1, "b"))),
        F.sum("dup_msgs").cast("bigint").alias("dup_msgs"),
        F.countDistinct("session_epoch").alias("sessions"),
        F.count_if(F.col("last_seq") >= F.coalesce("w_before", "first_seq") + WINDOW).alias("beyond_window"),
    )
    sent = out.agg(F.count(F.lit(1)).alias("msgs_emitted"))
    held = marked.where("class = 'ahead'").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("staged_msgs"))
    gaps = events.agg(F.count_if(F.col("event") == "GapOpened").alias("gap_opens"), F.count_if(F.col("event") == "ReAnchored").alias("reanchors"))
    return per.crossJoin(sent).crossJoin(held).crossJoin(gaps)  # one row each


def beyond_window(marked: DataFrame) -> DataFrame:
    """Packets that reach past the reorder window: the closed form holds for sessions without any; operators.exact sends the others to the sequencer."""
    return marked.where(F.col("last_seq") >= F.coalesce("w_before", "first_seq") + WINDOW)


def conformance(out: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows that break the output's law: seq is the last one plus one, gen never falls. Empty if all is well."""
    rows = running(out, F.expr(f"seq div {bucket}"), ["seq"], ["session_epoch"], inclusive=False, _last=("max", F.col("seq")), _gen=("max", F.col("gen")))
    return rows.where((F.col("_last") + 1 != F.col("seq")) | (F.col("_gen") > F.col("gen"))).drop("_last", "_gen")
