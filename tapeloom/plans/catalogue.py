"""Registry of the engine's own queries and of the SQL that must give the same rows."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import itch
from tapeloom.functions.binary import big_endian
from tapeloom.operators import arbitrate as A
from tapeloom.operators import book as B
from tapeloom.operators import exact, folds, lanes, measure, recovery, venue
from tapeloom.plans import oracles
from tapeloom.session import tables
from tapeloom.sources import derived as D
from tapeloom.sources import wire
from tapeloom.streaming import sequencer, windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)


def shared(spark: SparkSession) -> str:
    """A new folder that all executors share; sets a checkpoint folder where none is set, as in local runs."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file:///tmp/checkpoints/tapeloom"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    folder = f"{top.rstrip('/')}/engine-{uuid.uuid4().hex[:12]}"
    atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)  # where it is a path; stores have their own rules
    return folder


def feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dual feed's packets, what is emitted, and the packets with watermarks; checkpointed, as all three are used again and again."""
    shared(spark)
    packets = D.dual_feed(spark, sf_dir).checkpoint()
    out = A.emitted(packets).checkpoint()
    return packets, out, A.watermarks(packets, out).checkpoint()


def lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dual feed without its recovered copies: gaps that nobody closes."""
    return D.dual_feed(spark, sf_dir, recovered=False)


def tape_of(frames: DataFrame, name: str) -> DataFrame:
    return frames.select(F.lit(name).alias("tape"), "arrival", "vt", "feed", "frame")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.emitted(D.dual_feed(spark, sf_dir)).select("seq", "first_arrival", "emit_arrival")


@query
def feed_schedule(spark, d):
    return D.dual_feed(spark, d).select("arrival", "vt", "feed", "first_seq", "count")


@query
def frame_header_decode(spark, d):
    rows = D.encoded_feed(spark, d).withColumns(wire.header(F.col("frame")))
    return rows.select("arrival", "session", F.col("seq").cast("bigint"), "count", "kind", F.col("last_seq").cast("bigint"))


@query
def frame_parse_messages(spark, d):
    rows = wire.messages(wire.parse_frames(D.encoded_feed(spark, d)))
    from tapeloom.functions.binary import long

    return rows.select("arrival", "feed", "seq", F.length("msg").alias("size"), long(F.col("msg"), 1, 8).alias("carried"))


@query
def request_encode(spark, d):
    rows = recovery.requests(A.missing_ranges(lossy(spark, d)))
    return rows.select("from_seq", "count", F.hex(wire.request(F.lit(D.SESSION), F.col("from_seq"), F.col("count"))).alias("request"))


def _book_messages(spark, d, *types: str):
    """The book tape as bytes; of some types only, if named."""
    tape = D.book_tape(spark, d)
    return D.encoded_book(tape.where(F.col("type").isin(*types)) if types else tape)


@query
def itch_decode_header(spark, d):
    m = _book_messages(spark, d)
    return m.select("pos", *(c.alias(n) for n, c in itch.header(F.col("msg")).items()))


@query
def itch_decode_add(spark, d):
    return itch.decode(_book_messages(spark, d, "A"), "A").select("pos", "order_ref", "side", "shares", "price", "stock")


@query
def itch_decode_exec(spark, d):
    m = _book_messages(spark, d, "E", "C")
    e, c = itch.decode(m, "E"), itch.decode(m, "C")
    names = ["pos", "type", "order_ref", "shares", "match_number", "printable", "price"]
    return e.withColumns({"printable": F.lit(None).cast("string"), "price": F.lit(None).cast("bigint")}).select(names).unionByName(c.select(names))


@query
def itch_decode_cancel_delete(spark, d):
    m = _book_messages(spark, d, "X", "D")
    return itch.decode(m, "X").select("pos", "type", "order_ref", "shares").unionByName(itch.decode(m, "D").select("pos", "type", "order_ref", F.lit(None).cast("bigint").alias("shares")))


@query
def itch_decode_replace(spark, d):
    return itch.decode(_book_messages(spark, d, "U"), "U").select("pos", "order_ref", "new_ref", "shares", "price")


@query
def itch_validate_classes(spark, d):
    msg, pos = F.col("msg"), F.col("pos")
    bad = F.when(pos % 17 == 0, F.unhex(F.lit(""))).when(pos % 13 == 0, F.concat(F.unhex(F.lit("4F")), msg)).when(pos % 11 == 0, F.expr("substring(msg, 1, length(msg) - 1)")).otherwise(msg)
    rows = _book_messages(spark, d).select(F.coalesce(itch.error_class(bad), F.lit("ok")).alias("class"))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query
def type_histogram(spark, d):
    from pyspark.sql import Window

    rows = D.book_rows(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row for each type
    return rows.select("type", "n", F.expr("(20000 * n + total) div (2 * total)").alias("basis_points"))


@query
def feed_union_dedup(spark, d):
    rows = D.messages_of(D.dual_feed(spark, d), "arrival", "feed")
    return rows.groupBy("seq").agg(F.min("arrival").alias("arrival"), F.min_by("feed", "arrival").alias("feed"))


@query
def arb_emitted(spark, d):
    return A.emitted(D.dual_feed(spark, d)).select("seq", "first_arrival", "emit_arrival", "staged")


@query
def arb_sequencer(spark, d):
    rows = sequencer.arbitrate(tape_of(D.encoded_feed(spark, d), "main"))
    return rows.where("event = 'Message'").select(F.col("a").alias("seq"), "arrival", "gen")


@query
def arb_agreement(spark, d):
    """The closed form and the sequencer on the same feed: messages, and rows that only one of them has."""
    one, two = (f(spark, d).checkpoint() for f in (arb_sequencer, arb_eras))
    two = two.select("seq", F.col("emit_arrival").alias("arrival"), "gen")
    sides = one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(-1))).groupBy("seq", "arrival", "gen").agg(F.sum("side").alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    return sides.agg(F.sum("m").cast("bigint").alias("n_messages"), F.count_if(F.col("n") != 0).alias("differing"))


@query
def arb_open_gap(spark, d):
    """A session whose gap never closes: what stands before it, exactly."""
    return A.emitted(lossy(spark, d)).select("seq", "first_arrival", "emit_arrival")


@query
def arb_exact(spark, d):
    """Tapes that the closed form serves and tapes that need the sequencer, each by its own way."""
    shared(spark)
    frames = tape_of(D.encoded_feed(spark, d), "main").unionByName(D.rough_feed(spark, d))
    return exact.emitted(frames)


@query
def arb_rough_counters(spark, d):
    rows = sequencer.telemetry(D.rough_feed(spark, d))
    return rows.drop("ignored_after_dead", "intents_issued")


@query
def arb_open_counters(spark, d):
    rows = sequencer.telemetry(tape_of(D.encoded_feed(spark, d, recovered=False), "open"))
    return rows.drop("ignored_after_dead", "intents_issued")


@query
def arb_rough_events(spark, d):
    rows = sequencer.arbitrate(D.rough_feed(spark, d)).where("event <> 'Message'")
    return rows.select("tape", "arrival", "event", F.col("a").alias("from"), F.col("b").alias("to"), "gen", "note")


@query
def event_grammar_full(spark, d):
    """Gaps close, are flushed by a new session or stay open to the end; a session ends once; eras never fall."""
    from pyspark.sql import Window

    rows = sequencer.arbitrate(D.rough_feed(spark, d)).where("event <> 'Message'")
    order = Window.partitionBy("tape").orderBy("arrival", "gen", F.when(F.col("event") == "SessionBoundary", 0).otherwise(1))  # control events, few
    rows = rows.withColumns({"before": F.lag("event").over(order), "era": F.lag("gen").over(order)})
    event, before = F.col("event"), F.coalesce("before", F.lit(""))
    bad = (event == "GapOpened") & (before == "GapOpened") | (event == "ReAnchored") & (before != "GapOpened") | (event == "EndOfSession") & (before == "EndOfSession") | (F.col("era") > F.col("gen"))
    return rows.groupBy("tape").agg(*(F.count_if(event == name).alias(name) for name in ("GapOpened", "ReAnchored", "SessionBoundary", "EndOfSession")), F.count_if(bad).alias("violations"))


@query
def recovery_intents(spark, d):
    """What each tape's engine would ask for again, with its clock's grace and the retry cap."""
    return sequencer.intents(D.rough_feed(spark, d))


@query
def frame_kinds(spark, d):
    rows = D.rough_feed(spark, d).where("length(frame) >= 20").select("tape", "arrival", *(c.alias(n) for n, c in wire.header(F.col("frame")).items()))
    return rows.select("tape", "arrival", "session", "count", "kind", F.col("last_seq").cast("bigint").alias("last_seq"))


@query
def frame_errors(spark, d):
    rows = wire.parse_headers(D.rough_feed(spark, d))
    return rows.groupBy("tape", "kind", F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.sum("count").cast("bigint").alias("messages"))


@query
def arb_eras(spark, d):
    _, out, marked = feed(spark, d)
    return A.eras(out, A.gap_events(marked)).select("seq", "emit_arrival", "gen")


@query
def arb_watermark_by_packet(spark, d):
    return feed(spark, d)[2].select("arrival", "w_before", "w_after")


@query
def arb_packet_class(spark, d):
    return A.classes(feed(spark, d)[2]).select("arrival", "feed", "class", "dup_msgs")


@query
def arb_gap_events(spark, d):
    return A.gap_events(feed(spark, d)[2]).select("arrival", "event", "at", "ahead", "gen")


@query
def arb_counters(spark, d):
    _, out, marked = feed(spark, d)
    return A.counters(A.classes(marked), out, A.gap_events(marked))


@query
def arb_sessions(spark, d):
    rows = A.epochs(D.two_sessions(spark, d))
    return rows.groupBy("session_epoch").agg(F.min("session").alias("session"), F.count(F.lit(1)).alias("packets"), F.min("arrival").alias("first_arrival"), F.min_by("first_seq", "arrival").alias("anchor"))


@query
def arb_missing_ranges(spark, d):
    return A.missing_ranges(lossy(spark, d)).select("from_seq", "to_excl")


@query
def recovery_requests(spark, d):
    return recovery.requests(A.missing_ranges(lossy(spark, d))).select("from_seq", "count")


def truth(spark, d):
    return tables(spark, d, "events").select(F.lit(0).alias("session_epoch"), (F.col("event_id") + 1).alias("seq"), F.lit(12).alias("size"))


@query
def recovery_served(spark, d):
    return recovery.serve(recovery.requests(A.missing_ranges(lossy(spark, d))), truth(spark, d)).select("from_seq", "seq")


def recovered(spark, d):
    shared(spark)
    return A.emitted(recovery.recover(lossy(spark, d), truth(spark, d))[0])


@query
def recovery_faults(spark, d):
    """What the service returns under each of its faults."""
    shared(spark)
    asked = recovery.requests(A.missing_ranges(lossy(spark, d))).checkpoint()
    out = None
    for fault, n in recovery.FAULTS:
        rows = recovery.serve(asked, truth(spark, d), fault, n).select(F.lit(f"{fault}-{n}").alias("fault"), "from_seq", "seq", "wait_ns", "usable")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("fault").agg(F.count(F.lit(1)).alias("served"), F.countDistinct(F.when(F.col("usable"), F.col("seq"))).alias("usable"), F.max("wait_ns").alias("wait_ns"))


@query
def recovery_fixpoint(spark, d):
    return recovered(spark, d).select("seq")


@query
def conformance_check(spark, d):
    _, out, marked = feed(spark, d)
    out = A.eras(out, A.gap_events(marked)).checkpoint()
    return out.agg(F.count(F.lit(1)).alias("n_messages")).crossJoin(A.conformance(out).agg(F.count(F.lit(1)).alias("violations")))  # one row each


@query
def triple_equality(spark, d):
    got = recovered(spark, d).select("seq")
    want = truth(spark, d).select("seq").join(D.dual_feed(spark, d).agg(F.max("last_seq").alias("top")), F.col("seq") <= F.col("top")).select("seq")
    return got.exceptAll(want).agg(F.count(F.lit(1)).alias("left_only")).crossJoin(want.exceptAll(got).agg(F.count(F.lit(1)).alias("right_only")))  # one row each


@query
def event_grammar(spark, d):
    """Every opened gap is closed before the next one opens, and eras rise."""
    from pyspark.sql import Window

    order = Window.partitionBy("session_epoch").orderBy("arrival", "event")  # control events, few
    rows = A.gap_events(feed(spark, d)[2]).withColumns({"before": F.lag("event").over(order), "era": F.lag("gen").over(order)})
    opened = F.col("event") == "GapOpened"
    bad = (opened & (F.col("before") == "GapOpened")) | (~opened & (F.coalesce("before", F.lit("")) != "GapOpened")) | (F.col("era") > F.col("gen"))
    return rows.agg(F.count(F.lit(1)).alias("n_events"), F.count_if(opened).alias("opened"), F.count_if(bad).alias("violations"))


def spans(spark, d):
    return D.packets(spark, d).select("pkt", (F.col("pkt") * 10 + F.col("count")).alias("end"), (F.col("pkt") * 10 + 1).alias("first_seq"), F.col("count").cast("bigint").alias("messages"))


@query
def lane_merge(spark, d):
    rows = spans(spark, d)
    return lanes.merged(rows.where("pkt % 2 = 0"), rows.where("pkt % 2 = 1")).select("lane", "end", "first_seq", "position")


@query
def lane_totals(spark, d):
    rows = spans(spark, d).groupBy(F.expr("pkt div 7").alias("batch")).agg(F.count(F.lit(1)).alias("spans"), F.sum("messages").alias("messages"))
    return lanes.totals_before(rows).select("batch", "spans_before", "messages_before")


@query
def valid_prefixes(spark, d):
    pos = F.col("pos")
    bad = F.when(pos % 13 == 0, F.concat(F.unhex(F.lit("4F")), F.col("msg"))).otherwise(F.col("msg"))
    rows = _book_messages(spark, d).select(F.expr("pos div 16").alias("packet"), F.struct("pos", itch.error_class(bad).isNull().alias("ok")).alias("x"))
    rows = rows.groupBy("packet").agg(F.sort_array(F.collect_list("x")).alias("x")).withColumn("valid", F.col("x.ok"))  # sixteen a packet
    return rows.select("packet", lanes.valid_prefix().alias("prefix"))


@query
def seek_messages(spark, d):
    return D.book_tape(spark, d).where("pos BETWEEN 100 AND 199").select("pos", "type", "order_ref")


@query
def sampled_messages(spark, d):
    return D.book_tape(spark, d).where("pos % 256 = 0").select("pos", "type")


def book(spark, d) -> tuple[DataFrame, DataFrame]:
    shared(spark)
    tape = D.book_tape(spark, d).checkpoint()
    return tape, B.tokens(tape)


@query
def book_tokens(spark, d):
    return book(spark, d)[1].select("pos", "type", "locate", "seq", "px", "db", "da", "anomaly", "clamped")


@query
def book_telemetry(spark, d):
    tape, tokens = book(spark, d)
    return B.telemetry(tokens, tape)


@query
def book_volume_by_locate(spark, d):
    rows = B.by_locate(book(spark, d)[1])
    return rows.select("locate", F.col("db").alias("bid"), F.col("da").alias("ask")).crossJoin(rows.agg(F.count(F.lit(1)).alias("n_locates")))  # one row


@query
def last_trade_by_locate(spark, d):
    return B.by_locate(book(spark, d)[1]).where("seq > 0").select("locate", "px", "seq")


@query
def sig_chunks(spark, d):
    return B.chunks(book(spark, d)[1])


@query
def sig_locate_chunks(spark, d):
    return B.locate_chunks(book(spark, d)[1])


@query
def sig_global(spark, d):
    return book(spark, d)[1].rollup("locate").agg(F.sum("db").cast("bigint").alias("db"), F.sum("da").cast("bigint").alias("da"), F.max("seq").alias("seq"))


@query
def chunk_states(spark, d):
    return B.chunk_states(book(spark, d)[1])


@query
def setter_tags(spark, d):
    return B.tags(book(spark, d)[1])


@query
def book_from_feed(spark, d):
    """The same book from the wire: frames, arbitration, messages, tokens."""
    shared(spark)
    return B.tokens(arbitrated_book(spark, d).checkpoint()).select("pos", "type", "locate", "seq", "px", "db", "da", "anomaly", "clamped")


def arbitrated_book(spark, d) -> DataFrame:
    """Book messages as the dual feed delivers them: the first copy of each message in the contiguous prefix, decoded."""
    frames = D.book_feed(spark, d).checkpoint()
    packets = A.first_copies(wire.parse_frames(frames)).checkpoint()
    return itch.book_columns(packets.select(F.col("seq").alias("pos"), "msg"))


@query
def book_bake_audit(spark, d):
    """Tokens frozen as a table, and what differs when they are derived again from the wire."""
    folder = f"{shared(spark)}/baked"
    names = ["pos", "type", "locate", "seq", "px", "db", "da", "anomaly", "clamped"]
    book(spark, d)[1].select(names).write.parquet(folder)
    baked, again = spark.read.parquet(folder), book_from_feed(spark, d)
    sides = baked.withColumn("side", F.lit(1)).unionByName(again.withColumn("side", F.lit(-1))).groupBy(*names).agg(F.sum("side").alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    return sides.agg(F.sum("m").cast("bigint").alias("baked"), F.count_if(F.col("n") > 0).alias("baked_only"), F.count_if(F.col("n") < 0).alias("again_only"))


@query
def lob_window_states(spark, d):
    return B.lob_states(B.lob_events(D.book_tape(spark, d)))


@query
def best_price(spark, d):
    return B.lob_events(D.book_rows(spark, d).withColumn("pos", F.lit(0))).agg(F.max(F.when(F.col("kind") == "Add", F.col("px"))).alias("best_px"))


def directory_messages(spark, d) -> DataFrame:
    """A stock directory as messages: one for each locate."""
    n = F.col("n_nationkey")
    values = {"locate": n, "ts_ns": n * 1000, "stock": F.substring("n_name", 1, 8), "market_category": F.lit("Q"), "financial_status": F.lit("N"), "round_lot_size": (n + 1) * 100, "round_lots_only": F.when(n % 2 == 0, "Y").otherwise("N"), "etp_leverage": n % 4, "inverse_indicator": F.lit("N")}
    return tables(spark, d, "nation").select(itch.encode("R", values).alias("msg"))


@query
def itch_decode_directory(spark, d):
    return itch.decode(directory_messages(spark, d), "R").select("locate", "ts_ns", "stock", "market_category", "financial_status", "round_lot_size", "round_lots_only", "issue_classification", "etp_leverage", "inverse_indicator")


@query
def itch_decode_system(spark, d):
    code = F.substring(F.lit("OSQMEC"), (F.col("event_id") % 6 + 1).cast("int"), F.lit(1))
    msg = itch.encode("S", {"locate": F.lit(0), "tracking": F.col("event_id") % 7, "ts_ns": F.col("event_id") * 1_000_003, "event_code": code})
    return itch.decode(tables(spark, d, "events").select(msg.alias("msg")), "S").select("tracking", "ts_ns", "event_code")


@query
def itch_decode_attributed(spark, d):
    key = F.col("o_orderkey")
    values = {"locate": F.col("o_custkey") % 64, "ts_ns": key, "order_ref": key, "side": F.when(key % 2 == 0, "B").otherwise("S"), "shares": 1 + key * 37 % 200, "stock": F.concat(F.lit("SYM"), (F.col("o_custkey") % 64).cast("string")), "price": F.round(F.col("o_totalprice") * 100).cast("bigint"), "mpid": F.concat(F.lit("M"), (key % 100).cast("string"))}
    return itch.decode(tables(spark, d, "orders").select(itch.encode("F", values).alias("msg")), "F").select("order_ref", "locate", "side", "shares", "stock", "price", "mpid")


@query
def symbol_enrich(spark, d):
    """Volumes by symbol: the directory's messages decoded, joined by locate. It has a row for each of at most 2^16 locates."""
    directory = itch.decode(directory_messages(spark, d), "R").select(F.col("locate").alias("_locate"), F.col("stock").alias("symbol"))
    rows = B.by_locate(book(spark, d)[1]).join(directory, F.col("locate") % 25 == F.col("_locate"))
    return rows.groupBy("symbol").agg(F.sum("db").cast("bigint").alias("bid"), F.sum("da").cast("bigint").alias("ask"))


@query
def slot_demux(spark, d):
    return tables(spark, d, "orders").select((F.col("o_custkey") % 64).cast("int").alias("locate")).distinct().withColumn("slot", venue.slot(F.col("locate")))


@query
def window_digest_commutative(spark, d):
    return venue.digest(venue.digest(venue.window_records(book(spark, d)[1]), "slot", "window"), "window")


@query
def lane_overlap(spark, d):
    rows = spans(spark, d).groupBy(F.expr("pkt div 7").alias("batch")).agg(F.count(F.lit(1)).alias("spans"), F.sum("messages").alias("messages"))
    return lanes.overlap(rows, 10, 60)


@query
def slot_windows(spark, d):
    return venue.digest(venue.window_records(book(spark, d)[1]), "slot", "window").select("slot", "window", "v", "db", "da", "cnt")


@query
def merged_windows(spark, d):
    return venue.merged_windows(venue.window_records(book(spark, d)[1])).select("window", "cnt", "hash")


def _spans(spark, d) -> DataFrame:
    tape = D.book_tape(spark, d)
    return venue.span_records(D.encoded_book(tape, "locate"))


@query
def span_slot_windows(spark, d):
    """Each slot's span records of a window composed in order."""
    return folds.ring_fold(_spans(spark, d).select("slot", "window", "pos", "v", F.col("deg").alias("w")), "slot", "window")


@query
def span_window_merge(spark, d):
    """Windows closed over their slots: messages, bytes, and the composed records as one."""
    return span_slot_windows(spark, d).groupBy("window").agg(F.sum("cnt").alias("cnt"), F.sum("deg").cast("bigint").alias("deg"), F.bit_xor("v").alias("v"), F.bit_xor("c").alias("c"))


@query
def span_supers(spark, d):
    """A slot's windows composed to one record each, from the windows' records alone."""
    return folds.composed(span_slot_windows(spark, d).withColumnRenamed("window", "pos"), "slot")


@query
def trigger_reads(spark, d):
    pubs = D.publications(spark, d)
    return venue.trigger_reads(D.triggers(pubs), pubs).select("slot", "window", "w_prime", "claim", "read", F.expr("base_ns div 1000").alias("base_us"))


@query
def phantom_verdicts(spark, d):
    pubs = D.publications(spark, d)
    return venue.verdicts(venue.trigger_reads(D.triggers(pubs), pubs)).select("slot", "window", "verdict", "legal", "legal_full")


@query
def record_projections(spark, d):
    return D.publications(spark, d).select("slot", "window", *(venue.project(F.lit(k)).alias(f"phi{k}") for k in range(5)))


def samples(spark, d):
    e = F.col("event_id")
    flags = F.when(e % 29 == 0, measure.FIRST_TOUCH).when(e % 31 == 0, measure.PREV_CAPTURE).when(e % 37 == 0, measure.HB_EOS).when(e % 41 == 0, measure.EPOCH_EVENT).otherwise(0)
    m0 = e * 5000 + F.when(e % 53 == 0, 4000).otherwise(0)
    latency = e * 7919 % 3000 + F.when(e % 101 == 0, e * 3700 % 100_000_000).otherwise(0)
    return tables(spark, d, "events").select((e + 1).alias("seq"), latency.alias("latency"), m0.alias("m0"), (m0 + 1000).alias("m3"), flags.alias("flags"), (e % 64).alias("batch_pos"), F.lit(64).alias("batch_size"))


@query
def latency_histogram(spark, d):
    return measure.histogram(samples(spark, d))


@query
def latency_percentiles(spark, d):
    return measure.exact_percentiles(samples(spark, d), [50, 90, 99, 100])


@query
def histogram_percentiles(spark, d):
    return measure.histogram_percentiles(measure.histogram(samples(spark, d)), [50.0, 90.0, 99.0])


@query
def gate_verdicts(spark, d):
    """Percentiles against limits."""
    rows = measure.exact_percentiles(samples(spark, d), [50, 90, 99, 100])
    return rows.select("p", "x", measure.gate(F.col("x"), most=2000.0).alias("below_2000"), measure.gate(F.col("x"), least=1000.0).alias("from_1000"))


@query
def tail_taxonomy(spark, d):
    return measure.tail_causes(samples(spark, d), 2700)


@query
def theil_sen(spark, d):
    rows = tables(spark, d, "events").where("event_id < 256").select(F.col("event_id").alias("i"), F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("x"), (F.col("event_id") * 1000).alias("y"))
    return measure.theil_sen(rows).select(F.round(F.col("slope") * 1_000_000).cast("bigint").alias("slope_micro"), F.col("n").cast("bigint").alias("n"))


@query
def top_locates(spark, d):
    rows = book(spark, d)[1].groupBy("locate").agg(F.sum(F.abs("db") + F.abs("da")).cast("bigint").alias("volume"))
    return rows.orderBy(F.col("volume").desc(), "locate").limit(10)


@query
def bit_pack(spark, d):
    packed = F.shiftleft("event_id", 32).bitwiseOR(F.shiftleft(F.col("user_id").bitwiseAND(65535), 16)).bitwiseOR(F.col("event_id") % 10)
    p = F.col("packed")
    return tables(spark, d, "events").select("event_id", packed.alias("packed")).select(
        "event_id", "packed", F.shiftrightunsigned(p, 32).alias("off"), F.shiftrightunsigned(p, 16).bitwiseAND(65535).alias("len"), p.bitwiseAND(65535).alias("cnt")
    )


@query
def tape_audit(spark, d):
    """Messages as length-prefixed tape files, one for each part, read back through the binary reader."""
    from pyspark.sql import types as T

    folder = shared(spark)
    blocks = F.concat(big_endian(F.length("msg"), 2), F.col("msg"))
    rows = _book_messages(spark, d).select(F.expr("pos div 20000").alias("part"), "pos", blocks.alias("b"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        system, top = pafs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        part, out, n = None, None, 0
        for batch in batches:
            for own, b in zip(batch.column("part").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if own != part:
                    if out:
                        out.close()
                    part, out = own, system.open_output_stream(f"{top}/part-{own:05d}.tape")
                out.write(b)
                n += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(run, T.StructType([T.StructField("n", T.LongType())])).agg(F.sum("n")).collect()
    return wire.audit(wire.read_tape(spark, folder)).where("error IS NULL").select("type", "n")


@query
def audit_report(spark, d):
    """The audit as lines of text, the commonest type first."""
    return wire.report(type_histogram(spark, d))


@query
def golden_fnv(spark, d):
    rows = _book_messages(spark, d).select((F.expr("(pos - 1) div 128")).alias("part"), "pos", "msg")
    return folds.sequential(rows, ["part"])


@query
def crc_subtract(spark, d):
    """Each message's register from its part's cumulative ones."""
    rows = _book_messages(spark, d).select((F.expr("(pos - 1) div 512")).alias("part"), "pos", "msg")
    return folds.crc_parts(rows, ["part"])


@query
def span_crc(spark, d):
    return _spans(spark, d).select("pos", "slot", "window", "v", "c", "deg")


@query
def rot_fold(spark, d):
    return folds.rotate_fold(D.book_tape(spark, d).select("pos", F.col("order_ref").alias("v")))


@query
def spanhash_fold(spark, d):
    return folds.ring_fold(folds.ring_terms(_book_messages(spark, d)).withColumn("chunk", F.expr("(pos - 1) div 512")), "chunk")


@query
def spanhash_merge(spark, d):
    """Chunks from their halves: the fold of each half, merged by a shift in the ring."""
    half = folds.ring_fold(folds.ring_terms(_book_messages(spark, d)).withColumns({"chunk": F.expr("(pos - 1) div 512"), "half": F.expr("(pos - 1) div 256")}), "chunk", "half")
    return folds.composed(half.withColumnRenamed("half", "pos"), "chunk")


def _day(spark, d) -> DataFrame:
    return venue.digest(venue.window_records(book(spark, d)[1]), "slot", "window").withColumn("hash", venue.digest_hash())


@query
def day_chain(spark, d):
    return folds.chain(_day(spark, d))


@query
def day_verify(spark, d):
    """The chain once in closed form and once window by window: slots, and slots that differ."""
    shared(spark)
    records = _day(spark, d).select("slot", "window", "hash").checkpoint()
    both = folds.chain(records).join(folds.chain_in_order(records), "slot", "full")
    return both.agg(F.count(F.lit(1)).alias("slots"), F.count_if(~F.col("chain").eqNullSafe(F.col("ordered"))).alias("differing"))


@query
def state_digest(spark, d):
    return B.state_digest(book(spark, d)[1])


@query
def stream_arbitrate(spark, d):
    folder = shared(spark)
    frames = tape_of(D.encoded_feed(spark, d), "main")
    frames.coalesce(1).write.parquet(f"{folder}/frames")  # one file is one micro-batch; batches come in arrival order
    stream = spark.readStream.schema(frames.schema).parquet(f"{folder}/frames")
    rows = windows.run_to_end(sequencer.stream(stream), folder)
    return rows.where("event = 'Message'").select(F.col("a").alias("seq"), "arrival")


@query
def stream_tumbling_counts(spark, d):
    rows = windows.run_to_end(windows.tumbling_counts(windows.read_events(spark, d)), shared(spark), "complete")
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query
def stream_session_gaps(spark, d):
    rows = windows.run_to_end(windows.session_counts(windows.read_events(spark, d), lateness=None), shared(spark), "complete")
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query
def stream_distinct(spark, d):
    return windows.run_to_end(windows.distinct_within(windows.read_events(spark, d), ["event_id"]), shared(spark)).select("event_id")
