"""The closed form against the sequencer, and the sequencer's own rules."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import arbitrate as A
from tapeloom.operators import recovery
from tapeloom.streaming.sequencer import WINDOW, Sequencer, arbitrate


def frame(first, count, session="NFTESTSESS"):
    body = b"".join(b"\0\x0cS" + (first + i).to_bytes(8, "big") + b"   " for i in range(count)) if 0 < count < 0xFFFF else b""
    return session.encode() + struct.pack(">QH", first, count) + body


def run(frames, **options):
    own = Sequencer(**options)
    for k, f in enumerate(frames, 1):
        own.ingest(k, k % 2, k * 1000, f)
    return own


def sent(own):
    return [r[2] for r in own.out if r[1] == "Message"]


def events(own):
    return [r[1] for r in own.out if r[1] != "Message"]


def test_anchor_dups_and_partial_overlap():
    own = run([frame(100, 5), frame(100, 5), frame(103, 5), frame(90, 5)])
    assert sent(own) == list(range(100, 108)) and own.counts["dup_msgs"] == 5 + 2 + 5 and own.w == 108


def test_gap_opens_and_closes_with_eras():
    own = run([frame(1, 10), frame(21, 10), frame(11, 10)])
    assert sent(own) == list(range(1, 31)) and events(own) == ["GapOpened", "ReAnchored"]
    assert {r[4] for r in own.out if r[1] == "Message" and r[2] > 10} == {1}


def test_window_edge():
    own = run([frame(1, 1), frame(2 + WINDOW - 1, 3)])
    assert own.counts["staged_msgs"] == 1 and own.counts["beyond_window_dropped"] == 2 and own.evidence == 2 + WINDOW + 2


def test_passed_slots_are_cleared():
    own = run([frame(100, 1), frame(200, 6), frame(101, 105)])
    assert sent(own) == list(range(100, 206)) and not own.staged


def test_sessions_flush_and_restart():
    own = run([frame(1, 5), frame(9, 2), frame(1, 3, "SPLITSESS2"), frame(1, 5)])
    assert events(own) == ["GapOpened", "SessionBoundary", "SessionBoundary"] and own.counts["window_flushed"] == 1 and own.counts["sessions"] == 3


@pytest.mark.parametrize(("frames", "state", "named"), [
    ([frame(7, 0xFFFF)], "Ended", ["EndOfSession"]),
    ([frame(1, 5), frame(6, 0xFFFF), frame(6, 0xFFFF), frame(6, 2)], "Ended", ["EndOfSession"]),
    ([frame(1, 5), frame(9, 0xFFFF)], "EosPersist", []),
    ([frame(1, 5), frame(9, 0xFFFF), frame(6, 3), frame(9, 0xFFFF)], "Ended", ["EndOfSession"]),
])
def test_end_of_session(frames, state, named):
    own = run(frames)
    assert own.state == state and events(own) == named


def test_heartbeats():
    own = run([frame(50, 0), frame(1, 5), frame(9, 0), frame(6, 3)])
    assert events(own) == ["GapOpened", "ReAnchored"] and own.counts["heartbeats"] == 2


def test_intents_and_seal():
    own = run([frame(1, 5), frame(11, 5)])
    assert own.intent(1000 + 249_999) is None
    assert own.intent(1000 + 250_000) == (6, 15)
    assert own.intent(1000 + 250_001) is None and own.intent(1000 + 500_000) == (6, 15)
    own.ingest(3, 0, 600_000, frame(6, 5))
    assert own.pending is None
    own.seal(4, "RetryExhausted")
    own.seal(5, "again")
    own.ingest(6, 0, 0, frame(16, 1))
    assert own.state == "Dead" and own.counts["ignored_after_dead"] == 1 and events(own).count("SessionDead") == 1
    heard = run([frame(1, 5), frame(9, 0)])
    assert heard.intent(2000 + 250_000) == (6, 9)


def test_invalid_packets_apply_not_at_all():
    bad = bytearray(frame(6, 2))
    bad[-12] = ord("O")
    own = run([frame(1, 5), bytes(bad), frame(6, 2)])
    assert sent(own) == list(range(1, 8)) and own.counts["violations"] == 1


SCENARIOS = {"half_window": [frame(1, 1), *(frame(1 + WINDOW // 2 + k, 1) for k in range(0, 40)), frame(2, WINDOW // 2 - 1)], "keep_passed_slots": [frame(100, 1), frame(200, 6), frame(101, 105)], "drop_staged_at_end": [frame(1, 5), frame(7, 3), frame(10, 0xFFFF), frame(6, 1)]}


@pytest.mark.parametrize("mutation", sorted(SCENARIOS))
def test_injected_bugs_are_seen(mutation):
    good, bad = run(SCENARIOS[mutation]), run(SCENARIOS[mutation], mutation=mutation)
    assert (sent(good), good.counts, len(good.staged)) != (sent(bad), bad.counts, len(bad.staged))


def schedules(rnd, n):
    """Random deliveries of a two-feed stream: (tape, arrival, feed, first_seq, last_seq)."""
    rows = []
    for tape in range(n):
        cuts, at = [], 1
        while at < 120:
            size = rnd.randrange(1, 8)
            cuts.append((at, at + size - 1))
            at += size
        sends = []
        for feed in (0, 1):
            for k, (a, b) in enumerate(cuts):
                if rnd.random() > 0.12:
                    sends.append((k + rnd.random() * rnd.choice([1, 4, 12]), feed, a, b))
        rows += [(tape, i, feed, a, b) for i, (_, feed, a, b) in enumerate(sorted(sends), 1)]
    return rows


@pytest.mark.parametrize("bucket", [7, 4096])
def test_closed_form_equals_the_sequencer(spark, bucket):
    rows = schedules(random.Random(11), 25)
    packets = spark.createDataFrame([(t, k, f, a, b, b - a + 1) for t, k, f, a, b in rows], "session_epoch int, arrival bigint, feed int, first_seq bigint, last_seq bigint, count int").cache()
    out = A.emitted(packets, bucket).cache()
    marked = A.watermarks(packets, out, bucket).cache()
    ev = A.gap_events(marked, bucket).cache()
    assert A.beyond_window(marked).count() == 0
    messages = {(r.session_epoch, r.emit_arrival, r.seq, r.gen) for r in A.eras(out, ev, bucket).collect()}
    found = {(r.session_epoch, r.arrival, r.event, r["at"], r.ahead, r.gen) for r in ev.collect()}
    dups = {r.session_epoch: r.n for r in A.classes(marked).groupBy("session_epoch").agg(F.sum("dup_msgs").alias("n")).collect()}
    for tape in range(25):
        own = Sequencer()
        for _, k, f, a, b in [r for r in rows if r[0] == tape]:
            own.ingest(k, f, k, frame(a, b - a + 1))
        assert {(tape, k, a, g) for k, n, a, _, g, _ in own.out if n == "Message"} == {m for m in messages if m[0] == tape}
        assert {(tape, k, n, a, b, g) for k, n, a, b, g, _ in own.out if n != "Message"} == {e for e in found if e[0] == tape}
        assert dups[tape] == own.counts.get("dup_msgs", 0)
    assert A.conformance(A.eras(out, ev), bucket).count() == 0


def test_heartbeats_in_the_closed_form(spark):
    rnd = random.Random(21)
    rows, beats, owns = [], [], []
    for tape, sends in enumerate([r for r in schedules(rnd, 12) if r[0] == t] for t in range(12)):
        own, k = Sequencer(), 0
        for _, _, f, a, b in sends:
            if rnd.random() < 0.3:
                k += 1
                beats.append((tape, k, f, x := rnd.randrange(1, 140)))
                own.ingest(k, f, k, frame(x, 0))
            k += 1
            rows.append((tape, k, f, a, b, b - a + 1))
            own.ingest(k, f, k, frame(a, b - a + 1))
        owns.append(own)
    packets = spark.createDataFrame(rows, "session_epoch int, arrival bigint, feed int, first_seq bigint, last_seq bigint, count int")
    both = A.with_heartbeats(packets, spark.createDataFrame(beats, "session_epoch int, arrival bigint, feed int, next_seq bigint")).cache()
    out = A.emitted(both).cache()
    marked = A.watermarks(both, out).cache()
    found = {(r.session_epoch, r.arrival, r.event, r["at"], r.ahead, r.gen) for r in A.gap_events(marked).collect()}
    assert found == {(t, k, n, a, b, g) for t, own in enumerate(owns) for k, n, a, b, g, _ in own.out if n != "Message"}
    assert A.classes(marked).count() == len(rows)


def test_output_depends_on_the_delivered_set_alone(spark):
    rnd = random.Random(3)
    rows = [r for r in schedules(rnd, 1)]
    first = [r for r in rows if r[3] == 1][:1] or rows[:1]
    rest = [r for r in rows if r not in first]
    seen = set()
    for _ in range(4):
        rnd.shuffle(rest)
        data = [(0, k, f, a, b) for k, (_, _, f, a, b) in enumerate(first + rest, 1)]
        seen.add(tuple(sorted(r.seq for r in A.emitted(spark.createDataFrame(data, "session_epoch int, arrival bigint, feed int, first_seq bigint, last_seq bigint")).collect())))
    assert len(seen) == 1


def test_batch_group_keeps_arrival_order(spark):
    frames = [("t", k, k % 2, k, bytearray(frame(a, 5))) for k, a in enumerate([1, 11, 6, 16], 1)]
    out = arbitrate(spark.createDataFrame(frames[::-1], "tape string, arrival bigint, feed int, vt bigint, frame binary")).collect()
    assert [r.a for r in out if r.event == "Message"] == list(range(1, 21))


def test_epochs_count_every_change(spark):
    rows = [(k, s) for k, s in enumerate("AABBABB", 1)]
    got = {r.arrival: r.session_epoch for r in A.epochs(spark.createDataFrame(rows, "arrival bigint, session string"), 2).collect()}
    assert [got[k] for k in range(1, 8)] == [0, 0, 1, 1, 2, 3, 3]


@pytest.mark.parametrize(("fault", "n"), [("ok", 20), ("drop_request", 0), ("drop_response", 0), ("truncate", 2), ("duplicate_first", 22)])
def test_service_faults(spark, fault, n):
    asked = spark.createDataFrame([(0, 5, 10), (0, 1020, 10), (9, 1, 5)], "session_epoch int, from_seq bigint, count bigint")
    truth = spark.range(1, 3000).selectExpr("0 AS session_epoch", "id AS seq", "12 AS size")
    assert recovery.serve(asked, truth, fault).count() == n


def test_requests_respect_the_wire_limit(spark):
    rows = recovery.requests(spark.createDataFrame([(0, 10, 140_000)], "session_epoch int, from_seq bigint, to_excl bigint")).orderBy("from_seq").collect()
    assert [(r.from_seq, r["count"]) for r in rows] == [(10, 65535), (65545, 65535), (131080, 8920)]


def test_recovery_closes_dual_drops(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    data = [(0, k, f, a, a + 9, 10) for k, (f, a) in enumerate([(0, 1), (1, 1), (0, 21), (1, 21), (1, 51)], 1)]
    packets = spark.createDataFrame(data, "session_epoch int, arrival bigint, feed int, first_seq bigint, last_seq bigint, count int")
    truth = spark.range(1, 61).selectExpr("0 AS session_epoch", "id AS seq", "12 AS size")
    whole, dead = recovery.recover(packets, truth)
    assert not dead and sorted(r.seq for r in A.emitted(whole).collect()) == list(range(1, 61))
    assert recovery.recover(packets, truth.where("seq > 15"), rounds=2)[1]


def test_the_clock_walks_through_silence_until_the_session_is_dead():
    from tapeloom.streaming.sequencer import GRACE, REPEATS, Driven

    own = Driven()
    for k, (vt, f) in enumerate([(0, frame(1, 5)), (1000, frame(11, 5)), (10 * GRACE, frame(16, 5))], 1):
        own.ingest(k, 0, vt, f)
    # The first evaluation after QUIET of no progress is at the third frame; nothing was pending before, so the clock didn't walk.
    assert [i[:4] for i in own.intents] == [(3, 10 * GRACE, 6, 20)] and own.state == "Gap"
    own.ingest(4, 0, 20 * GRACE, frame(21, 1))
    asked = [(i[1], i[4]) for i in own.intents]
    assert asked == [(10 * GRACE + k * GRACE, k) for k in range(REPEATS + 1)]
    assert own.state == "Dead" and own.counts["ignored_after_dead"] == 1 and events(own)[-1] == "SessionDead"


def test_exact_routing(spark, tmp_path):
    """Tapes of the closed form and tapes past the window, against the sequencer."""
    from tapeloom.operators import exact

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    tapes = {
        "plain": [frame(1, 10), frame(21, 10), frame(11, 10), frame(11, 10)],
        "far": [frame(1, 10), frame(21, 10), frame(1500, 10), frame(11, 10), frame(31, 1469), frame(1510, 2)],
        "sessions": [frame(1, 5), frame(9, 2), frame(1, 3, "OTHERONE00")],
        "bad": [frame(1, 5), frame(6, 5)[:-1], frame(6, 5)],
        "beats": [frame(1, 5), frame(9, 0), frame(6, 5), frame(11, 0xFFFF)],
    }
    rows = [(t, k, k % 2, k * 1000, bytearray(f)) for t, fs in tapes.items() for k, f in enumerate(fs, 1)]
    frames = spark.createDataFrame(rows, "tape string, arrival bigint, feed int, vt bigint, frame binary")
    got = {tuple(r) for r in exact.emitted(frames).collect()}
    assert got == {(t, r[2], r[0], r[4]) for t, fs in tapes.items() for r in run(fs).out if r[1] == "Message"}
    assert {r.tape for r in exact.split(frames)[2].collect()} == {"far", "sessions", "bad", "beats"}
    counts = {r.tape: r for r in __import__("tapeloom.streaming.sequencer", fromlist=["telemetry"]).telemetry(frames).collect()}
    assert counts["far"].beyond_window_dropped == 10 and counts["bad"].block_overrun == counts["bad"].violations == 1
