"""Feeds derived from the driver tables: a dual lossy feed with its recovered copies, two-session and rough forms of it, a book tape, publications and triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.binary import big_endian, padded
from tapeloom.functions.itch import encode
from tapeloom.functions.ordering import numbered
from tapeloom.session import tables

SESSION, SECOND = "TAPELOOM01", "TAPELOOM02"
#: Packets per bucket of the arrival order (vt rises by 10,000 a packet), about.
VT_BUCKET = 500_000_000


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pkt, count: ten events a packet."""
    events = tables(spark, sf_dir, "events").select("event_id")
    return events.groupBy(F.expr("event_id div 10").alias("pkt")).agg(F.count(F.lit(1)).cast("int").alias("count"))


#: A packet that both feeds lost is delivered once more, as feed 2, this long after its time (60 packets: within the reorder window).
RECOVERY, LATE_RECOVERY = 600_000, 1_200_000


def _deliveries(pkt: Column, base: Column, hole: Column, spared: Column, late: Column) -> Column:
    """The deliveries (feed, vt, lost) of a packet: both feeds, and the copy that recovery brings if both lost it (late: after its time, null for never)."""
    lost_a, lost_b = ~spared & ((pkt * 7919 + 13) % 1000 < 50) | hole, ~spared & ((pkt * 6271 + 101) % 1000 < 50) | hole
    one = lambda feed, vt, lost: F.struct(F.lit(feed).alias("feed"), vt.cast("bigint").alias("vt"), lost.alias("lost"))
    recovered = one(2, base + F.coalesce(late, F.lit(0)), ~(lost_a & lost_b) | late.isNull())
    return F.array(one(0, base + pkt * 31 % 7 * 4000, lost_a), one(1, base + pkt * 17 % 11 * 5000, lost_b), recovered)


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feeds' packets and the recovered copies with virtual times and losses: pkt, feed, first_seq, count, vt, lost."""
    p = F.col("pkt")
    sent = _deliveries(p, p * 10000, p.between(40, 42), p == 0, F.lit(RECOVERY))
    rows = packets(spark, sf_dir).select("pkt", "count", F.explode(sent).alias("f"))
    return rows.select("pkt", F.col("f.feed").alias("feed"), (p * 10 + 1).alias("first_seq"), "count", F.col("f.vt").alias("vt"), F.col("f.lost").alias("lost"))


def dual_feed(spark: SparkSession, sf_dir: str, recovered: bool = True) -> DataFrame:
    """Delivered packets in arrival order: arrival, vt, feed, pkt, session, session_epoch, first_seq, count, last_seq. Without the
    recovered copies the gaps stay open for ever."""
    rows = schedule(spark, sf_dir).where("NOT lost" if recovered else "NOT lost AND feed < 2").drop("lost")
    rows = numbered(rows, F.expr(f"vt div {VT_BUCKET}"), ["vt", "feed", "first_seq"], "arrival")
    return rows.select("arrival", "vt", "feed", "pkt", F.lit(SESSION).alias("session"), F.lit(0).alias("session_epoch"), "first_seq", "count", (F.col("first_seq") + F.col("count") - 1).alias("last_seq"))


def two_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dual feed whose second half is another session that starts at 1 again, later in time; no epoch yet."""
    half = packets(spark, sf_dir).agg(F.expr("(max(pkt) + 1) div 2").alias("half"))
    rows = schedule(spark, sf_dir).where("NOT lost").drop("lost").crossJoin(F.broadcast(half))  # one row
    late = F.col("pkt") >= F.col("half")
    rows = rows.withColumns({"session": F.when(late, SECOND).otherwise(SESSION), "first_seq": F.when(late, F.col("first_seq") - F.col("half") * 10).otherwise(F.col("first_seq")), "vt": F.when(late, F.col("vt") + 10_000_000).otherwise(F.col("vt"))})
    rows = numbered(rows, F.expr(f"vt div {VT_BUCKET}"), ["vt", "feed", "session", "first_seq"], "arrival")
    return rows.select("arrival", "vt", "feed", "pkt", "session", "first_seq", "count", (F.col("first_seq") + F.col("count") - 1).alias("last_seq"))


def messages_of(frames: DataFrame, *keep: str) -> DataFrame:
    """One row for each message of the packets: seq and the columns to keep."""
    return frames.select(*keep, F.explode(F.sequence("first_seq", "last_seq")).alias("seq"))


def system_event(seq: Column) -> Column:
    """The 12-byte message that carries its own number."""
    return F.concat(padded(F.lit("S"), 1), big_endian(seq, 8), padded(F.lit(""), 3))


def frame(session: Column, first_seq: Column, count: Column, blocks: Column) -> Column:
    """Header and length-prefixed blocks as bytes."""
    payload = F.aggregate(blocks, F.unhex(F.lit("")), lambda a, m: F.concat(a, big_endian(F.length(m), 2), m))
    return F.concat(padded(session, 10), big_endian(first_seq, 8), big_endian(count, 2), payload)


def encoded_feed(spark: SparkSession, sf_dir: str, recovered: bool = True) -> DataFrame:
    """The dual feed as bytes: arrival, vt, feed, frame."""
    rows = dual_feed(spark, sf_dir, recovered)
    blocks = F.transform(F.sequence("first_seq", "last_seq"), system_event)
    return rows.select("arrival", "vt", "feed", frame(F.col("session"), F.col("first_seq"), F.col("count"), blocks).alias("frame"))


#: Packets of a tape of the rough feed, and of its first session.
TAPE, FIRST_SESSION = 200, 150
ENDS, SESSION_GAP = 3, 2_000_000


def rough_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapes with everything that can go wrong: tape, arrival, vt, feed, kind, bad, session, first_seq, count.

    Each tape has two sessions with heartbeats, end-of-session trains and a packet after the end. Two packets of the first
    session are lost on both feeds; every third tape gets them back later than the reorder window reaches, every third
    never. Broken frames (bad 0 to 5: cut short, a byte too many, a block past the end, an unknown type, numbers past 2^64,
    an empty block) come beside the whole ones."""
    p, local = F.col("pkt"), F.col("local")
    rows = packets(spark, sf_dir).withColumns({"tape": F.expr(f"pkt div {TAPE}"), "local": p % TAPE})
    second = local >= FIRST_SESSION
    rows = rows.withColumns({"second": second, "first_seq": (local - F.when(second, FIRST_SESSION).otherwise(0)) * 10 + 1, "base": local * 10000 + F.when(second, SESSION_GAP).otherwise(0)})
    hole, third = local.between(20, 21), F.col("tape") % 3
    late = F.when(~hole | (third == 0), RECOVERY).when(third == 1, LATE_RECOVERY)
    sent = _deliveries(p, F.col("base"), hole, local.isin(0, FIRST_SESSION), late)
    names = ["tape", "vt", "feed", "kind", "bad", "second", "first_seq", "count"]
    none = F.lit(None).cast("int")
    data = rows.select("*", F.explode(sent).alias("f")).where("NOT f.lost").select("tape", "f.vt", "f.feed", F.lit("data").alias("kind"), none.alias("bad"), "second", "first_seq", "count")
    broken = rows.where("local % 29 = 13").select("tape", (F.col("base") + 1).alias("vt"), F.lit(0).alias("feed"), F.lit("data").alias("kind"), F.expr("cast((local div 29 + tape) % 6 as int)").alias("bad"), "second", "first_seq", "count")
    beats = rows.where("local % 16 = 7").select("tape", (F.col("base") + 5000).alias("vt"), F.lit(1).alias("feed"), F.lit("heartbeat").alias("kind"), none.alias("bad"), "second", (F.col("first_seq") + F.col("count")).alias("first_seq"), F.lit(0).alias("count"))
    last = rows.groupBy("tape", "second").agg(F.max("base").alias("base"), F.max("first_seq").alias("first_seq"), F.max_by("count", "local").alias("count"))
    train = F.array(*(F.struct(F.lit(f).alias("feed"), (F.col("base") + 1_500_000 + k * 10_000).alias("vt")) for k in range(ENDS) for f in (0, 1)))
    ends = last.select("*", F.explode(train).alias("f")).select("tape", "f.vt", "f.feed", F.lit("end").alias("kind"), none.alias("bad"), "second", (F.col("first_seq") + F.col("count")).alias("first_seq"), F.lit(0xFFFF).alias("count"))
    after = last.where("second").select("tape", (F.col("base") + 1_600_000).alias("vt"), F.lit(0).alias("feed"), F.lit("data").alias("kind"), none.alias("bad"), "second", "first_seq", "count")
    rows = data.select(names).unionByName(broken.select(names)).unionByName(beats.select(names)).unionByName(ends.select(names)).unionByName(after.select(names))
    order = Window.partitionBy("tape").orderBy("vt", "feed", F.coalesce("bad", F.lit(-1)), "kind", "first_seq")  # some hundred rows a tape
    return rows.select("tape", F.row_number().over(order).cast("bigint").alias("arrival"), "vt", "feed", "kind", "bad", F.when(F.col("second"), SECOND).otherwise(SESSION).alias("session"), "first_seq", "count")


def rough_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rough tapes as bytes: tape, arrival, vt, feed, frame."""
    rows = rough_schedule(spark, sf_dir)
    bad, data = F.col("bad"), F.col("kind") == "data"
    # Numbers past 2^64 and the extra empty block change the header; the other faults change the finished frame.
    blocks = F.when(data, F.transform(F.expr("sequence(first_seq, first_seq + count - 1)"), system_event)).otherwise(F.array().cast("array<binary>"))
    blocks = F.when(bad == 5, F.concat(blocks, F.array(F.unhex(F.lit(""))))).otherwise(blocks)
    whole = frame(F.col("session"), F.col("first_seq"), F.col("count") + F.when(bad == 5, 1).otherwise(0), blocks)
    size = F.length("whole")
    broken = (
        F.when(bad == 0, F.expr("substring(whole, 1, 12)")).when(bad == 1, F.concat("whole", F.unhex(F.lit("00")))).when(bad == 2, F.substring("whole", F.lit(1), size - 1))
        .when(bad == 3, F.concat(F.substring("whole", F.lit(1), size - 12), F.encode(F.lit("O"), "US-ASCII"), F.substring("whole", size - 10, F.lit(11))))
        .when(bad == 4, F.concat(F.expr("substring(whole, 1, 10)"), F.unhex(F.lit("F" * 16)), F.substring("whole", F.lit(19), size - 18))).otherwise(F.col("whole"))
    )
    return rows.withColumn("whole", whole).select(F.format_string("rough-%05d", "tape").alias("tape"), "arrival", "vt", "feed", broken.alias("frame"))


def _days(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date"))


#: Order references per bucket of a day.
REFS = 1_000_000
BOOK = ["day", "kind", "order_ref", "new_ref", "type", "locate", "side", "q", "px", "printable"]


def book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order adds, executions, cancels, deletes and replaces, in no order yet."""
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    none = lambda t: F.lit(None).cast(t)
    orders = tables(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_ref"), _days("o_orderdate").alias("day"), (F.col("o_custkey") % 64).cast("int").alias("locate"), cents("o_totalprice").alias("total"))
    key = F.col("order_ref")
    adds = orders.select("day", F.lit(0).alias("kind"), "order_ref", none("bigint").alias("new_ref"), F.lit("A").alias("type"), "locate", F.when(key % 2 == 0, "B").otherwise("S").alias("side"), (1 + key * 37 % 200).alias("q"), F.col("total").alias("px"), none("string").alias("printable"))
    shift = (F.col("l_partkey") * 13 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 120 - 2
    kinds = F.when(F.col("l_returnflag") == "A", "E").when(F.col("l_returnflag") == "N", "X").otherwise("C")
    lines = tables(spark, sf_dir, "lineitem").join(orders.select("order_ref", "day", "locate"), F.col("l_orderkey") == key)
    lines = lines.select((F.col("day") + shift).cast("int").alias("day"), F.lit(1).alias("kind"), "order_ref", none("bigint").alias("new_ref"), kinds.alias("type"), "locate", none("string").alias("side"), F.col("l_quantity").cast("bigint").alias("q"), cents("l_extendedprice").alias("px"), F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("printable"))

    def later(days: int, kind: int, every: int, name: str, old: Column, new: Column, q: Column) -> DataFrame:
        return orders.where(key % every == 0).select((F.col("day") + days).alias("day"), F.lit(kind).alias("kind"), old.alias("order_ref"), new.alias("new_ref"), F.lit(name).alias("type"), "locate", none("string").alias("side"), q.alias("q"), F.when(F.lit(name == "U"), F.col("total")).alias("px"), none("string").alias("printable"))

    nothing = none("bigint")
    replaces = later(40, 2, 7, "U", key, key + 10_000_000, 1 + key * 11 % 150).unionByName(later(60, 2, 21, "U", key + 10_000_000, key + 20_000_000, 1 + key * 11 % 150))
    deletes = later(80, 3, 5, "D", key, nothing, nothing)
    return adds.unionByName(lines).unionByName(replaces).unionByName(deletes).select(*BOOK)


def book_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book's messages with their position in the tape. Buckets of the order are a day's references of one kind."""
    bucket = F.struct("day", "kind", F.expr(f"order_ref div {REFS}").alias("part"))
    return numbered(book_rows(spark, sf_dir), bucket, [F.col(c).asc_nulls_first() for c in BOOK], "pos")


def encoded_book(tape: DataFrame, *keep: str) -> DataFrame:
    """The book tape as messages: pos, type, msg and the columns to keep. The day is the clock, in nanoseconds."""
    values = {"locate": F.col("locate"), "ts_ns": F.col("day").cast("bigint") * 1000, "order_ref": F.col("order_ref"), "new_ref": F.coalesce("new_ref", F.lit(0)), "side": F.coalesce("side", F.lit(" ")), "shares": F.coalesce("q", F.lit(0)), "price": F.coalesce("px", F.lit(0)), "printable": F.coalesce("printable", F.lit(" ")), "match_number": F.col("pos"), "stock": F.concat(F.lit("SYM"), F.col("locate").cast("string"))}
    msg = F.lit(None).cast("binary")
    for kind in "AECXDU":
        msg = F.when(F.col("type") == kind, encode(kind, values)).otherwise(msg)
    return tape.select("pos", "type", msg.alias("msg"), *keep)


def book_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book tape's messages as a dual feed of ten a packet, with the dual feed's losses and recovered copies: arrival, feed, frame."""
    p = F.col("pkt")
    rows = encoded_book(book_tape(spark, sf_dir)).select(F.expr("(pos - 1) div 10").alias("pkt"), F.struct("pos", "msg").alias("m"))
    rows = rows.groupBy("pkt").agg(F.sort_array(F.collect_list("m")).alias("m"))  # ten a packet
    rows = rows.select("pkt", frame(F.lit(SESSION), p * 10 + 1, F.size("m"), F.col("m.msg")).alias("frame"))
    sent = _deliveries(p, p * 10000, p.between(40, 42), p == 0, F.lit(RECOVERY))
    rows = rows.select("pkt", "frame", F.explode(sent).alias("f")).where("NOT f.lost").select("pkt", "frame", "f.feed", "f.vt")
    return numbered(rows, F.expr(f"vt div {VT_BUCKET}"), ["vt", "feed", "pkt"], "arrival").select("arrival", "feed", "frame")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned publications: slot, window, pub_ns, v, c, deg, cnt."""
    events = tables(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return events.groupBy((F.col("user_id") % 8).cast("int").alias("slot"), F.expr("cast(event_id div 100 as int)").alias("window")).agg(
        F.max(ns).alias("pub_ns"), F.expr("bit_xor(event_id * 2654435761)").alias("v"), F.expr("bit_xor(event_id * 40503 + user_id)").alias("c"), F.sum("user_id").cast("bigint").alias("deg"), F.count(F.lit(1)).alias("cnt")
    )


def triggers(pubs: DataFrame) -> DataFrame:
    """A trigger for each publication but a slot's first: it pins the window before; some are fabricated, stale or early."""
    rows = pubs.where("window > 0").withColumn("n", F.col("slot") * 100_000 + F.col("window"))
    reads = pubs.select(F.col("slot").alias("_s"), F.col("window").alias("_w"), F.col("v").alias("read"), F.col("pub_ns").alias("base_ns"))
    rows = rows.withColumn("w_prime", F.col("window") - 1).join(reads, (F.col("slot") == F.col("_s")) & (F.col("w_prime") == F.col("_w")))
    claim = F.when(F.col("n") % 17 == 0, F.col("read").bitwiseXOR(1)).otherwise(F.col("read"))
    w = F.when(F.col("n") % 19 == 0, F.col("w_prime") + 1_000_000).otherwise(F.col("w_prime"))
    arrival = F.when(F.col("n") % 23 == 0, F.col("base_ns") - 50_000).otherwise(F.col("base_ns") + 20_000)
    return rows.select("slot", (F.col("window") % 8).alias("reader"), "window", w.cast("int").alias("w_prime"), (F.col("n") % 20 + 1).cast("int").alias("depth"), arrival.alias("arrival_ns"), claim.alias("claim"))
