"""The order book against a register, folds against their sequential laws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import hashes as H
from tapeloom.operators import book, folds, measure, venue

TAPE = "pos bigint, type string, order_ref bigint, new_ref bigint, side string, q bigint, px bigint, printable string, locate int"


def tapes(rnd, n):
    rows, ref = [], 0
    for pos in range(1, n + 1):
        kind = rnd.choice("AAFECXDUPN")
        a, b = rnd.randrange(12), 100 + rnd.randrange(12) if rnd.random() < 0.5 else rnd.randrange(12)
        rows.append((pos, kind, a, b if kind == "U" else None, rnd.choice("BS") if kind in "AF" else None, rnd.randrange(1, 40), rnd.randrange(1, 99), rnd.choice("YN"), rnd.randrange(4)))
        ref += 1
    return rows


def register(rows):
    """Tokens by a dictionary of live orders."""
    live, out = {}, {}
    for pos, kind, ref, new, side, q, px, printable, _ in rows:
        db = da = seq = price = 0
        anomaly = clamped = False
        if kind in "AF":
            live[ref] = [side, q, px]
            own, change = side, q
        elif kind in "PQ":
            seq, price, own, change = pos, px, "B", 0
        elif kind in "ECXDU":
            if ref not in live:
                anomaly, own, change = True, "B", 0
            else:
                own, rem, opx = live[ref]
                if kind in "ECX":
                    change, clamped = -min(q, rem), q > rem
                    live[ref][1] = max(0, rem - q)
                    if kind == "E":
                        seq, price = pos, opx
                    elif kind == "C" and printable == "Y":
                        seq, price = pos, px
                else:
                    del live[ref]
                    change = -rem
                    if kind == "U":
                        live[new] = [own, q, px]
                        change = q - rem
        else:
            own, change = "B", 0
        db, da = (0, change) if own == "S" else (change, 0)
        out[pos] = (seq, price, db, da, anomaly, clamped)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tokens_equal_the_register(spark, tmp_path, seed):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    rows = tapes(random.Random(seed), 160)
    got = {r.pos: (r.seq, r.px, r.db, r.da, r.anomaly, r.clamped) for r in book.tokens(spark.createDataFrame(rows, TAPE)).collect()}
    assert got == register(rows)


def test_lob_states_and_prices(spark):
    events = spark.createDataFrame([(1, "Add", 100, 10), (2, "Add", 104, 30), (3, "Exec", 100, 10)], "i bigint, kind string, px bigint, qty bigint")
    last = book.lob_states(events).first()
    assert (last.volume, last["count"], last.vwap) == (30, 1, 104)
    assert [r.volume for r in book.lob_states(events, 2).orderBy("block").collect()] == [40, 30]


def test_signatures_recombine(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i, rnd.randrange(3), rnd.choice([0, i]), rnd.randrange(50), rnd.randrange(-9, 9), rnd.randrange(-9, 9)) for i in range(1, 3000)], "pos bigint, locate int, seq bigint, px bigint, db bigint, da bigint")
    whole = book.signature(rows).first()
    parts = book.signature(book.chunks(rows).select("seq", "px", "db", "da")).first()
    assert whole == parts and book.signature(book.locate_chunks(rows).select("seq", "px", "db", "da")).first() == whole
    states = book.chunk_states(rows).orderBy("chunk").collect()
    assert (states[-1].b, states[-1].a, states[-1].p) == (whole.db, whole.da, whole.px)


def test_checksums():
    assert H.crc32c(b"123456789") == 0xE3069283
    words = lambda w, n: H.reduce(int(np.bitwise_xor.reduce([0])) ^ __import__("functools").reduce(lambda a, b: a ^ b, (H.clmul(t, k) for t, k in zip([*w, n], H.SPAN_KEYS, strict=True))))
    assert words([1, 0, 0, 0], 1) == 0x72F1AB46FFAC63C3
    assert words([2**64 - 1, 0, 0, 0], 0) == 0x1A619CE5AFDFB722
    assert words([0, 0, 0, 0], 2**32 - 1) == 0xDBE044E0F5524FBC
    assert words([0xDEADBEEFCAFEBABE, 0x0123456789ABCDEF, 0xFEDCBA9876543210, 0x13579BDF2468ACE0], 1364) == 0x5B57584402D1A224
    body = bytes(range(200))
    assert H.span_lanes(body) != H.span_lanes(body[::-1]) and H.span_lanes(b"") == 0


def test_ring_laws():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(0, 2**63, 50, dtype=np.uint64) * 2 + 1 for _ in range(3))
    assert np.array_equal(H.mulmod_array(H.mulmod_array(a, b), c), H.mulmod_array(a, H.mulmod_array(b, c)))
    assert [int(x) for x in H.mulmod_array(a, b)] == [H.mulmod(int(x), int(y)) for x, y in zip(a, b, strict=True)]
    assert H.power(64) == H.RING_LOW and H.mulmod(H.power(100), H.power(33)) == H.power(133)


def test_rotate_fold_equals_the_loop(spark):
    v = [random.Random(2).getrandbits(63) for _ in range(300)]
    h = H.FNV_SEED
    for x in v:
        h = H.rotl(h, 13) ^ (x * H.GOLDEN & H.MASK)
    got = folds.rotate_fold(spark.createDataFrame(list(enumerate(v, 1)), "pos bigint, v bigint")).first()
    assert got.n == 300 and got.fold & H.MASK == h


@pytest.mark.parametrize("cut", [1, 7, 300])
def test_ring_fold_is_the_ordered_product_and_merges(spark, cut):
    rnd = random.Random(4)
    rows = [(i, rnd.getrandbits(63), rnd.choice([19, 23, 36])) for i in range(1, 301)]
    h = 0
    for _, v, w in rows:
        h = H.mulmod(h, H.power(w)) ^ v
    frame = spark.createDataFrame(rows, "pos bigint, v bigint, w bigint")
    got = folds.ring_fold(frame).first()
    assert got.v & H.MASK == h and got.deg == sum(w for *_, w in rows) and got.c & H.MASK == H.power(got.deg)
    parts = sorted((r.part, r.v & H.MASK, r.deg) for r in folds.ring_fold(frame.withColumn("part", F.expr(f"pos div {cut}")), "part").collect()) if cut > 1 else [(0, h, got.deg)]
    total = (0, 0)
    for _, v, deg in parts:
        total = folds.compose(total, (v, deg))
    assert total == (h, got.deg)


def test_sequential_hashes(spark):
    rows = [(k % 3, k, bytearray(bytes([k % 256]) * (k % 20))) for k in range(1, 90)]
    got = {r.part: r for r in folds.sequential(spark.createDataFrame(rows, "part int, pos bigint, msg binary"), ["part"]).collect()}
    for part in range(3):
        g = f = H.FNV_SEED
        for p, _, m in rows:
            if p == part:
                g, f = H.fnv(H.fnv(g, len(m).to_bytes(2, "little")), m), H.fast_step(f, m)
        assert (got[part].golden & H.MASK, got[part].fast & H.MASK) == (g, f)


def test_affine_product(spark):
    rnd = random.Random(6)
    rows = [(0, i, [rnd.randrange(9) for _ in range(16)], [rnd.randrange(9) for _ in range(4)]) for i in range(12)]
    got = folds.affine(spark.createDataFrame(rows[::-1], "k int, pos bigint, m array<bigint>, b array<bigint>"), ["k"]).first()
    x = np.array([1, 2, 3, 4], np.uint64)
    y = x
    for _, _, m, b in rows:
        y = np.array(m, np.uint64).reshape(4, 4) @ y + np.array(b, np.uint64)
    m, b = np.array(got.m, np.int64).view(np.uint64).reshape(4, 4), np.array(got.b, np.int64).view(np.uint64)
    assert np.array_equal(m @ x + b, y)


def test_slots_and_histogram(spark):
    rows = spark.range(0, 65536, 97).select("id", venue.slot(F.col("id"), 7).alias("s")).collect()
    assert all(r.s == ((r.id * H.GOLDEN & H.MASK) >> 24) % 7 for r in rows)
    x = [0, 5, 1023, 1024, 1039, 1040, 5000, 2**20 + 12345, 2**26 - 1, 2**26, 2**40]
    got = {r.x: (r.b, r.e) for r in spark.createDataFrame([(v,) for v in x], "x bigint").select("x", measure.bucket(F.col("x")).alias("b")).select("x", "b", measure.lower_edge(F.col("b")).alias("e")).collect()}
    for v in x:
        log = v.bit_length() - 1
        want = v if v < 1024 else 1024 + (log - 10) * 64 + (((v - (1 << log)) << 6) >> log) if log < 26 else 2048
        assert got[v][0] == want and got[v][1] <= v


def test_phantoms(spark):
    pubs = spark.createDataFrame([(0, 0, 100_000, 5, 6, 7, 8)], "slot int, window int, pub_ns bigint, v bigint, c bigint, deg bigint, cnt bigint")
    cases = [(0, 0, 1, 0, 1, 200_000, 5), (0, 0, 1, 9, 1, 200_000, 5), (0, 0, 1, 0, 1, 80_000, 5), (0, 0, 1, 0, 1, 90_000, 4), (0, 0, 1, 0, 17, 200_000, 5)]
    asked = spark.createDataFrame(cases, "slot int, reader int, window int, w_prime int, depth int, arrival_ns bigint, claim bigint")
    assert sorted(r.verdict for r in venue.verdicts(venue.trigger_reads(asked, pubs)).collect()) == ["deep", "early", "fabricated", "ok", "stale"]


def test_dead_replacements_in_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(book, "ROUNDS", 2, raising=False)
    rows = [(i, "U", 1, None, 10, 100, None, i + 1, i + 2) for i in range(6)]  # the first one's order is unknown
    tape = spark.createDataFrame(rows, "pos bigint, type string, locate int, side string, q bigint, px bigint, printable string, order_ref bigint, new_ref bigint")
    assert not book.resolve(tape).where("role = 0 AND alive").count()


def test_a_chain_of_replacements_longer_than_any_bound(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    # An order ends, then 9 replacements follow each other from it; each new reference is used once.
    rows = [(1, "A", 0, None, "B", 10, 5, "Y", 0), (2, "D", 0, None, None, 0, 0, "Y", 0)]
    for k in range(9):
        rows += [(3 + 2 * k, "U", k, k + 1, None, 7, 5, "Y", 0), (4 + 2 * k, "X", k + 1, None, None, 1, 0, "Y", 0)]
    got = {r.pos: r.anomaly for r in book.tokens(spark.createDataFrame(rows, TAPE)).collect()}
    assert got == {pos: pos > 2 for pos in range(1, len(rows) + 1)}


def test_sums_wrap(spark):
    rows = spark.createDataFrame([(k, 0, 0, 0, 2**62, -(2**62) - k) for k in range(1, 6)], "pos bigint, locate int, seq bigint, px bigint, db bigint, da bigint")
    wrapped = lambda x: (x + 2**63) % 2**64 - 2**63
    one = book.signature(rows).first()
    assert (one.db, one.da) == (wrapped(5 * 2**62), wrapped(-5 * 2**62 - 15))
    assert book.chunk_states(rows).first().b == wrapped(5 * 2**62)
    events = spark.createDataFrame([(k, "Add", 2**32 - 1, 2**32 - 1) for k in (1, 2, 3)], "i bigint, kind string, px bigint, qty bigint")
    assert book.lob_states(events).first().pv == wrapped(3 * (2**32 - 1) ** 2)


def test_messages_without_a_reference_leave_the_book_alone(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    rows = [(1, "S", None, None, None, None, None, None, 0), (2, "A", 1, None, "B", 5, 9, None, 0), (3, "H", None, None, None, None, None, None, 0)]
    assert {(r.pos, r.db, r.seq) for r in book.tokens(spark.createDataFrame(rows, TAPE)).collect()} == {(1, 0, 0), (2, 5, 0), (3, 0, 0)}


def test_rows_hash_like_single_messages():
    rnd = random.Random(1)
    data = [rnd.randbytes(rnd.choice([0, 1, 19, 36, 50, 64, 65, 130, 200])) for _ in range(300)]
    assert H.crc_rows(data).tolist() == [H.crc_update(0, d) for d in data]
    assert H.span_lanes_rows(data).tolist() == [H.span_lanes(d) for d in data]
    seeds = np.full(60, H.FNV_SEED, np.uint64)
    assert H.fnv_many(seeds, data[:60]).tolist() == [H.fnv(H.FNV_SEED, d) for d in data[:60]]
    counts, at = np.array([100, 0, 80, 120]), 0
    for n, got in zip(counts.tolist(), H.fast_many(seeds[:4], counts, data).tolist(), strict=True):
        h = H.FNV_SEED
        for m in data[at : at + n]:
            h = H.fast_step(h, m)
        at += n
        assert h == got


def test_folds_carry_a_key_over_slabs(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(k % 3, k, bytearray(rnd.randbytes(rnd.randrange(40)))) for k in range(300)]
    frame = spark.createDataFrame(rows, "part int, pos bigint, msg binary")
    monkeypatch.setattr(folds, "SLAB", 700)
    got = {r.part: (r.n_messages, r.golden, r.fast) for r in folds.sequential(frame, ["part"]).collect()}
    for part in range(3):
        golden = fast = H.FNV_SEED
        own = [bytes(m) for p, _, m in rows if p == part]
        for m in own:
            golden, fast = H.fnv(H.fnv(golden, len(m).to_bytes(2, "little")), m), H.fast_step(fast, m)
        assert got[part] == (len(own), *H.signed([golden, fast]).tolist())
