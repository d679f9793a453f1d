"""The same results in DuckDB SQL, from the driver tables alone."""

from __future__ import annotations

FEED = """
p AS (SELECT event_id // 10 AS pkt, CAST(count(*) AS INTEGER) AS cnt FROM events GROUP BY 1),
sch0 AS (
    SELECT pkt, cnt, pkt <> 0 AND (pkt * 7919 + 13) % 1000 < 50 OR pkt BETWEEN 40 AND 42 AS lost_a, pkt <> 0 AND (pkt * 6271 + 101) % 1000 < 50 OR pkt BETWEEN 40 AND 42 AS lost_b FROM p
),
sch AS (
    SELECT pkt, 0 AS feed, pkt * 10 + 1 AS first_seq, cnt, pkt * 10000 + ((pkt * 31) % 7) * 4000 AS vt, lost_a AS lost FROM sch0
    UNION ALL SELECT pkt, 1, pkt * 10 + 1, cnt, pkt * 10000 + ((pkt * 17) % 11) * 5000, lost_b FROM sch0
    UNION ALL SELECT pkt, 2, pkt * 10 + 1, cnt, pkt * 10000 + 600000, NOT (lost_a AND lost_b) FROM sch0
),
fr AS (SELECT row_number() OVER (ORDER BY vt, feed, first_seq) AS arrival, vt, feed, pkt, first_seq, cnt, first_seq + cnt - 1 AS last_seq FROM sch WHERE NOT lost),
ms AS (SELECT arrival, feed, unnest(generate_series(first_seq, last_seq)) AS seq FROM fr),
fa AS (SELECT seq, min(arrival) AS first_arrival FROM ms GROUP BY 1),
an AS (SELECT arg_min(first_seq, arrival) AS anchor FROM fr),
em0 AS (SELECT seq, first_arrival, max(first_arrival) OVER (ORDER BY seq) AS emit_arrival, row_number() OVER (ORDER BY seq) AS n, anchor FROM fa, an WHERE seq >= anchor),
em AS (SELECT seq, first_arrival, emit_arrival, emit_arrival > first_arrival AS staged FROM em0 WHERE seq - n = anchor - 1),
st AS (SELECT emit_arrival AS arrival, count(*) AS k FROM em GROUP BY 1),
wm AS (
    SELECT fr.*, anchor + sum(coalesce(k, 0)) OVER (ORDER BY fr.arrival) AS w_after,
        CASE WHEN fr.arrival > 1 THEN anchor + sum(coalesce(k, 0)) OVER (ORDER BY fr.arrival) - coalesce(k, 0) END AS w_before
    FROM fr LEFT JOIN st ON fr.arrival = st.arrival, an
),
cl AS (
    SELECT *, CASE WHEN last_seq < coalesce(w_before, first_seq) THEN 'duplicate' WHEN first_seq <= coalesce(w_before, first_seq) THEN 'contiguous' ELSE 'ahead' END AS class FROM wm
),
cd AS (SELECT *, CASE class WHEN 'duplicate' THEN cnt WHEN 'contiguous' THEN coalesce(w_before, first_seq) - first_seq ELSE 0 END AS dup_msgs FROM cl),
ev0 AS (SELECT *, CASE WHEN class = 'ahead' THEN first_seq END AS x FROM cd),
ev1 AS (
    SELECT *, coalesce(max(x) OVER (ORDER BY arrival), 0) AS e, coalesce(max(x) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e0, coalesce(w_before, 0) AS w0 FROM ev0
),
ev2 AS (SELECT *, CASE WHEN w0 >= e0 AND w_after < e THEN 'GapOpened' WHEN w0 < e0 AND w_after >= e THEN 'ReAnchored' END AS event FROM ev1),
ev AS (
    SELECT arrival, event, w_after AS "at", CASE WHEN event = 'GapOpened' THEN x END AS ahead, sum(CASE WHEN event = 'GapOpened' THEN 1 ELSE 0 END) OVER (ORDER BY arrival) AS gen FROM ev2 WHERE event IS NOT NULL
),
miss AS (SELECT lag_seq + 1 AS from_seq, seq AS to_excl FROM (SELECT seq, coalesce(lag(seq) OVER (ORDER BY seq), anchor - 1) AS lag_seq FROM fa, an WHERE seq >= anchor) WHERE seq > lag_seq + 1),
req AS (SELECT from_seq + k * 65535 AS from_seq, least(65535, to_excl - from_seq - k * 65535) AS cnt FROM (SELECT *, unnest(generate_series(0, (to_excl - from_seq - 1) // 65535)) AS k FROM miss))
"""

#: The feed without recovered copies: gaps that stay open.
LOSSY = FEED.replace("WHERE NOT lost)", "WHERE NOT lost AND feed < 2)")

# The window rule, frame by frame: a row is a tape's state after a frame, with what the frame did. fx has tape, n, feed, kind, bad, session, seq, cnt, size.
STEPS = """
step AS (
    SELECT tape, CAST(0 AS BIGINT) AS n, '' AS sess, 'Init' AS st, CAST(0 AS BIGINT) AS w, false AS gap, CAST(0 AS BIGINT) AS ev, CAST(0 AS BIGINT) AS gen, CAST([] AS BIGINT[]) AS staged, '' AS op, '' AS st0, CAST(0 AS BIGINT) AS lo,
        false AS fresh, '' AS bound, false AS flushed, false AS opens, false AS closes, CAST(0 AS BIGINT) AS put, CAST(0 AS BIGINT) AS gone, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS cnt, CAST(0 AS BIGINT) AS feed,
        CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS bad FROM (SELECT DISTINCT tape FROM fx)
    UNION ALL
    SELECT tape, n, sess, CASE WHEN op = 'end' THEN CASE WHEN st0 = 'Ended' OR st0 = 'Init' OR w >= seq THEN 'Ended' ELSE 'EosPersist' END WHEN closes THEN 'Contig' WHEN opens THEN 'Gap' WHEN op = 'apply' AND st0 = 'Init' THEN 'Contig' ELSE st0 END,
        w, (gap OR opens) AND NOT closes, CASE WHEN closes THEN 0 ELSE ev END, gen, staged, op, st0, lo, fresh, bound, flushed, opens, closes, put, gone, seq, cnt, feed, size, bad
    FROM (
        SELECT * EXCLUDE (w, staged, ev, gen), CASE WHEN op = 'apply' THEN seq + cnt + len(ready) ELSE w END AS w, CASE op WHEN 'apply' THEN kept[len(ready) + 1:] WHEN 'ahead' THEN list_distinct(list_concat(staged, range(seq, seq + put))) ELSE staged END AS staged,
            ev1 AS ev, gen + CASE WHEN opens THEN 1 ELSE 0 END AS gen, (gap OR opens) AND op = 'apply' AND seq + cnt + len(ready) >= ev1 AS closes
        FROM (
            SELECT *, CASE WHEN op = 'apply' THEN list_filter(kept, lambda x, i: x - i = seq + cnt - 1) ELSE [] END AS ready,
                CASE WHEN op = 'ahead' THEN greatest(0, least(seq + cnt, w + 1024) - seq) ELSE 0 END AS put, CASE WHEN op = 'ahead' THEN cnt - greatest(0, least(seq + cnt, w + 1024) - seq) ELSE 0 END AS gone,
                greatest(CASE WHEN NOT evident THEN ev WHEN gap THEN greatest(ev, seq) ELSE seq END, CASE WHEN op = 'ahead' AND seq + cnt - 1 >= w + 1024 THEN seq + cnt ELSE 0 END) AS ev1, evident AND NOT gap AS opens
            FROM (
                SELECT *, CASE WHEN op = 'apply' AND st0 = 'Init' THEN seq ELSE w END AS lo, op = 'ahead' OR op = 'heartbeat' AND st0 NOT IN ('Init', 'Ended') AND seq > w AS evident,
                    CASE WHEN op = 'apply' THEN list_sort(list_filter(staged, lambda x: x > seq + cnt - 1)) ELSE [] END AS kept
                FROM (
                    SELECT * EXCLUDE (st, staged, gap, ev, gen), CASE WHEN cut THEN 'fault' WHEN kind <> 'data' THEN kind WHEN st0 = 'Ended' THEN 'late' WHEN bad IS NOT NULL THEN 'fault' WHEN st0 <> 'Init' AND seq + cnt - 1 < w THEN 'dup' WHEN st0 = 'Init' OR seq <= w THEN 'apply' ELSE 'ahead' END AS op,
                        CASE WHEN bound = '' THEN staged ELSE [] END AS staged, gap AND bound = '' AS gap, CASE WHEN bound = '' THEN ev ELSE 0 END AS ev, gen + CASE WHEN bound = '' THEN 0 ELSE 1 END AS gen, bound <> '' AND len(staged) > 0 AS flushed
                    FROM (
                        SELECT s.tape, f.n, CASE WHEN f.bad = 0 THEN s.sess ELSE f.session END AS sess, s.st, s.w, s.gap, s.ev, s.gen, s.staged, coalesce(f.bad = 0, false) AS cut, coalesce(f.bad, 1) <> 0 AND s.sess <> f.session AS fresh,
                            CASE WHEN coalesce(f.bad, 1) <> 0 AND s.sess <> f.session AND s.sess <> '' THEN s.sess || '>' || f.session ELSE '' END AS bound, CASE WHEN coalesce(f.bad, 1) <> 0 AND s.sess <> f.session THEN 'Init' ELSE s.st END AS st0,
                            f.kind, f.seq, f.cnt, f.feed, f.size, f.bad
                        FROM step s JOIN fx f ON f.tape = s.tape AND f.n = s.n + 1
                    )
                )
            )
        )
    )
)
"""
ROUGH = FEED + """,
rl AS (
    SELECT *, NOT spared AND (pkt * 7919 + 13) % 1000 < 50 OR hole AS lost_a, NOT spared AND (pkt * 6271 + 101) % 1000 < 50 OR hole AS lost_b, CASE WHEN NOT hole OR tape % 3 = 0 THEN 600000 WHEN tape % 3 = 1 THEN 1200000 END AS late
    FROM (SELECT pkt, cnt, pkt // 200 AS tape, pkt % 200 AS loc, pkt % 200 >= 150 AS second, (pkt % 200 - CASE WHEN pkt % 200 >= 150 THEN 150 ELSE 0 END) * 10 + 1 AS first_seq, pkt % 200 * 10000 + CASE WHEN pkt % 200 >= 150 THEN 2000000 ELSE 0 END AS base,
        pkt % 200 BETWEEN 20 AND 21 AS hole, pkt % 200 IN (0, 150) AS spared FROM p)
),
rlast AS (SELECT tape, second, max(base) AS base, max(first_seq) AS first_seq, arg_max(cnt, loc) AS cnt FROM rl GROUP BY 1, 2),
rx AS (
    SELECT tape, base + (pkt * 31) % 7 * 4000 AS vt, 0 AS feed, 'data' AS kind, CAST(NULL AS BIGINT) AS bad, second, first_seq, cnt FROM rl WHERE NOT lost_a
    UNION ALL SELECT tape, base + (pkt * 17) % 11 * 5000, 1, 'data', NULL, second, first_seq, cnt FROM rl WHERE NOT lost_b
    UNION ALL SELECT tape, base + late, 2, 'data', NULL, second, first_seq, cnt FROM rl WHERE lost_a AND lost_b AND late IS NOT NULL
    UNION ALL SELECT tape, base + 1, 0, 'data', (loc // 29 + tape) % 6, second, first_seq, cnt FROM rl WHERE loc % 29 = 13
    UNION ALL SELECT tape, base + 5000, 1, 'heartbeat', NULL, second, first_seq + cnt, 0 FROM rl WHERE loc % 16 = 7
    UNION ALL SELECT tape, base + 1500000 + k * 10000, f, 'end', NULL, second, first_seq + cnt, 65535 FROM rlast, range(3) a(k), range(2) b(f)
    UNION ALL SELECT tape, base + 1600000, 0, 'data', NULL, second, first_seq, cnt FROM rlast WHERE second
),
rough AS (
    SELECT printf('rough-%05d', tape) AS tape, row_number() OVER (PARTITION BY tape ORDER BY vt, feed, coalesce(bad, -1), kind, first_seq) AS n, feed, kind, bad, CASE WHEN second THEN 'TAPELOOM02' ELSE 'TAPELOOM01' END AS session, first_seq AS seq, cnt,
        CASE WHEN kind <> 'data' THEN 20 WHEN bad = 0 THEN 12 ELSE 20 + 14 * cnt + CASE bad WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 5 THEN 2 ELSE 0 END END AS size FROM rx
)
"""
OPEN = LOSSY + ", fx AS (SELECT 'open' AS tape, arrival AS n, feed, 'data' AS kind, CAST(NULL AS BIGINT) AS bad, 'TAPELOOM01' AS session, first_seq AS seq, cnt, 20 + 14 * cnt AS size FROM fr)"
COUNTS = """SELECT tape, {names} FROM (
    SELECT tape, count(*) FILTER (feed % 2 = 0) AS packets_0, count(*) FILTER (feed % 2 = 1) AS packets_1, count(*) FILTER (op = 'dup' AND feed % 2 = 0) AS dups_0, count(*) FILTER (op = 'dup' AND feed % 2 = 1) AS dups_1,
        sum(size) FILTER (feed % 2 = 0) AS bytes_0, sum(size) FILTER (feed % 2 = 1) AS bytes_1, count(*) FILTER (op = 'fault' AND bad = 0) AS truncated, count(*) FILTER (op = 'fault' AND bad = 1) AS trailing_bytes,
        count(*) FILTER (op = 'fault' AND bad = 2) AS block_overrun, count(*) FILTER (op = 'fault' AND bad = 4) AS seq_overflow, count(*) FILTER (op = 'fault' AND bad IN (3, 5)) AS payload_invalid, count(*) FILTER (op IN ('fault', 'late')) AS violations,
        sum(put) AS staged_msgs, coalesce(sum(CASE op WHEN 'dup' THEN cnt WHEN 'apply' THEN lo - seq END), 0) AS dup_msgs, sum(gone) AS beyond_window_dropped, count(*) FILTER (flushed) AS window_flushed, count(*) FILTER (opens) AS gap_opens,
        count(*) FILTER (closes) AS reanchors, count(*) FILTER (op = 'heartbeat') AS heartbeats, count(*) FILTER (op = 'end' AND st0 NOT IN ('Ended', 'EosPersist')) AS eos_seen, count(*) FILTER (op = 'end' AND st0 IN ('Ended', 'EosPersist')) AS eos_dup,
        count(*) FILTER (fresh) AS sessions, count(*) FILTER (op = 'late') AS data_after_eos, coalesce(sum(w - lo) FILTER (op = 'apply'), 0) AS msgs_emitted FROM step WHERE n > 0 GROUP BY 1)"""
COUNTED = "packets_0 packets_1 dups_0 dups_1 bytes_0 bytes_1 truncated trailing_bytes block_overrun seq_overflow payload_invalid violations staged_msgs dup_msgs beyond_window_dropped window_flushed gap_opens reanchors heartbeats eos_seen eos_dup sessions data_after_eos msgs_emitted".split()
COUNTS = COUNTS.format(names=", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in COUNTED))
EVENTS = """evs AS (
    SELECT tape, n, 0 AS k, 'SessionBoundary' AS event, CAST(NULL AS BIGINT) AS "from", CAST(NULL AS BIGINT) AS "to", gen - CASE WHEN opens THEN 1 ELSE 0 END AS gen, bound AS note FROM step WHERE bound <> ''
    UNION ALL SELECT tape, n, 1, 'GapOpened', w, seq, gen, NULL FROM step WHERE opens
    UNION ALL SELECT tape, n, 2, 'ReAnchored', w, NULL, gen, NULL FROM step WHERE closes
    UNION ALL SELECT tape, n, 3, 'EndOfSession', w, seq, gen, NULL FROM step WHERE op = 'end' AND st = 'Ended' AND st0 <> 'Ended'
)"""

BOOK = """
o AS (
    SELECT o_orderkey AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(o_custkey % 64 AS INTEGER) AS locate, CAST(round(o_totalprice * 100) AS BIGINT) AS total FROM orders
),
rows0 AS (
    SELECT day, 0 AS kind, k AS order_ref, CAST(NULL AS BIGINT) AS new_ref, 'A' AS type, locate, CASE WHEN k % 2 = 0 THEN 'B' ELSE 'S' END AS side, 1 + (k * 37) % 200 AS q, total AS px, CAST(NULL AS VARCHAR) AS printable FROM o
    UNION ALL
    SELECT day + (l_partkey * 13 + l_suppkey * 7 + l_linenumber) % 120 - 2, 1, k, NULL, CASE l_returnflag WHEN 'A' THEN 'E' WHEN 'N' THEN 'X' ELSE 'C' END, locate, NULL, CAST(l_quantity AS BIGINT),
        CAST(round(l_extendedprice * 100) AS BIGINT), CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END FROM lineitem JOIN o ON l_orderkey = k
    UNION ALL SELECT day + 40, 2, k, k + 10000000, 'U', locate, NULL, 1 + (k * 11) % 150, total, NULL FROM o WHERE k % 7 = 0
    UNION ALL SELECT day + 60, 2, k + 10000000, k + 20000000, 'U', locate, NULL, 1 + (k * 11) % 150, total, NULL FROM o WHERE k % 21 = 0
    UNION ALL SELECT day + 80, 3, k, NULL, 'D', locate, NULL, NULL, NULL, NULL FROM o WHERE k % 5 = 0
),
t AS (
    SELECT row_number() OVER (ORDER BY day, kind, order_ref, new_ref NULLS FIRST, type, locate, side NULLS FIRST, q NULLS FIRST, px NULLS FIRST, printable NULLS FIRST) AS pos, * FROM rows0
)
"""

# Each reference is born once: adds under their key, replacements under new keys, alive from birth to its first delete or replacement.
TOKENS = BOOK + """,
b0 AS (SELECT order_ref AS ref, pos AS born, q AS shares, px, side FROM t WHERE type = 'A'),
e0 AS (SELECT t.order_ref AS ref, min(t.pos) AS died FROM t JOIN b0 ON t.order_ref = b0.ref AND t.pos > b0.born WHERE type IN ('D', 'U') GROUP BY 1),
b1 AS (SELECT t.new_ref AS ref, t.pos AS born, t.q AS shares, t.px, b0.side FROM t JOIN b0 ON t.order_ref = b0.ref LEFT JOIN e0 USING (ref) WHERE t.type = 'U' AND t.pos > b0.born AND t.pos <= coalesce(e0.died, t.pos)),
b01 AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1),
e1 AS (SELECT t.order_ref AS ref, min(t.pos) AS died FROM t JOIN b01 ON t.order_ref = b01.ref AND t.pos > b01.born WHERE type IN ('D', 'U') GROUP BY 1),
b2 AS (SELECT t.new_ref AS ref, t.pos AS born, t.q AS shares, t.px, b1.side FROM t JOIN b1 ON t.order_ref = b1.ref LEFT JOIN e1 USING (ref) WHERE t.type = 'U' AND t.pos > b1.born AND t.pos <= coalesce(e1.died, t.pos)),
b AS (SELECT * FROM b01 UNION ALL SELECT * FROM b2),
e AS (SELECT t.order_ref AS ref, min(t.pos) AS died FROM t JOIN b ON t.order_ref = b.ref AND t.pos > b.born WHERE type IN ('D', 'U') GROUP BY 1),
r AS (
    SELECT t.*, b.side AS bside, b.px AS bpx, b.shares, b.born IS NOT NULL AND t.pos > b.born AND t.pos <= coalesce(e.died, t.pos) AS alive,
        coalesce(sum(CASE WHEN t.type IN ('E', 'C', 'X') AND t.pos > b.born THEN t.q ELSE 0 END) OVER (PARTITION BY t.order_ref ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
    FROM t LEFT JOIN b ON t.order_ref = b.ref LEFT JOIN e ON t.order_ref = e.ref
),
s AS (SELECT *, greatest(0, shares - taken) AS rem FROM r),
c AS (
    SELECT pos, type, locate, px, bpx, printable, CASE WHEN type = 'A' THEN side ELSE bside END AS sd, type <> 'A' AND NOT alive AS anomaly, alive,
        CASE WHEN type = 'A' THEN q WHEN NOT alive THEN 0 WHEN type IN ('E', 'C', 'X') THEN -least(q, rem) WHEN type = 'D' THEN -rem ELSE q - rem END AS change,
        type IN ('E', 'C', 'X') AND alive AND q > rem AS clamped, type = 'E' AND alive AND q > rem AS zero_rem
    FROM s
),
tok AS (
    SELECT pos, type, locate, CASE WHEN trades THEN pos ELSE 0 END AS seq, CASE WHEN trades THEN CASE WHEN type = 'E' THEN bpx ELSE px END ELSE 0 END AS px,
        CAST(CASE WHEN sd = 'S' THEN 0 ELSE change END AS BIGINT) AS db, CAST(CASE WHEN sd = 'S' THEN change ELSE 0 END AS BIGINT) AS da, anomaly, coalesce(clamped, false) AS clamped, coalesce(zero_rem, false) AS zero_rem
    FROM (SELECT *, alive AND (type = 'E' OR type = 'C' AND printable = 'Y') AS trades FROM c)
)
"""

PUBS = """
pub AS (
    SELECT CAST(user_id % 8 AS INTEGER) AS slot, CAST(event_id // 100 AS INTEGER) AS "window", max(epoch_us(ts)) * 1000 AS pub_ns, bit_xor(event_id * 2654435761) AS v, bit_xor(event_id * 40503 + user_id) AS c,
        CAST(sum(user_id) AS BIGINT) AS deg, count(*) AS cnt FROM events GROUP BY 1, 2
),
trg AS (
    SELECT a.slot, CAST(a."window" % 8 AS BIGINT) AS reader, a."window", CASE WHEN n % 19 = 0 THEN a."window" - 1 + 1000000 ELSE a."window" - 1 END AS w_prime, CAST(n % 20 + 1 AS INTEGER) AS depth,
        CASE WHEN n % 23 = 0 THEN b.pub_ns - 50000 ELSE b.pub_ns + 20000 END AS arrival_ns, CASE WHEN n % 17 = 0 THEN xor(b.v, 1) ELSE b.v END AS claim
    FROM (SELECT *, slot * 100000 + "window" AS n FROM pub WHERE "window" > 0) a JOIN pub b ON a.slot = b.slot AND a."window" - 1 = b."window"
),
rd AS (SELECT trg.*, pub.v AS read, pub.pub_ns AS base_ns FROM trg LEFT JOIN pub ON trg.slot = pub.slot AND trg.w_prime = pub."window")
"""

SAMPLES = """
sm AS (
    SELECT event_id + 1 AS seq, (event_id * 7919) % 3000 + CASE WHEN event_id % 101 = 0 THEN (event_id * 3700) % 100000000 ELSE 0 END AS latency,
        event_id * 5000 + CASE WHEN event_id % 53 = 0 THEN 4000 ELSE 0 END AS m0, CAST(CASE WHEN event_id % 29 = 0 THEN 1 WHEN event_id % 31 = 0 THEN 2 WHEN event_id % 37 = 0 THEN 4 WHEN event_id % 41 = 0 THEN 8 ELSE 0 END AS INTEGER) AS flags,
        event_id % 64 AS batch_pos, 64 AS batch_size FROM events
)
"""
ROT = lambda x, k: f"((({x})::BIT << {k}) | (({x})::BIT >> {64 - k}))"


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def qr(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


RX = ROUGH + ", fx AS (SELECT * FROM rough)," + STEPS
OX = OPEN + "," + STEPS

SLOT = "CAST(((locate::HUGEINT * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT // 16777216) % 8 AS INTEGER)"

# Messages as hex digits, and as bytes.
MSG = BOOK + """,
mh AS (
    SELECT pos, type, locate, hex(type) || printf('%04X', locate) || '0000' || printf('%012X', CAST(day AS BIGINT) * 1000) || printf('%016X', order_ref) || CASE type
        WHEN 'A' THEN hex(side) || printf('%08X', q) || hex(rpad('SYM' || locate, 8, ' ')) || printf('%08X', px) WHEN 'E' THEN printf('%08X', q) || printf('%016X', pos) WHEN 'C' THEN printf('%08X', q) || printf('%016X', pos) || hex(printable) || printf('%08X', px)
        WHEN 'X' THEN printf('%08X', q) WHEN 'D' THEN '' ELSE printf('%016X', new_ref) || printf('%08X', q) || printf('%08X', px) END AS h FROM t
),
mb AS (SELECT *, length(h) // 2 AS size, list_transform(range(0, length(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM mh),
mv AS (SELECT *, list_reduce(list_transform(b, lambda x: CAST(x AS UHUGEINT)), lambda c, x: c * 256 + x) AS whole, flatten(list_transform(b, lambda x: list_transform(range(8), lambda k: (x >> k) & 1))) AS bits FROM mb)
"""
M64, GOLD = "18446744073709551616::UHUGEINT", "11400714819323198485::UHUGEINT"
U = lambda x: f"CAST((CAST({x} AS HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS UHUGEINT)"
S64 = lambda x: f"CAST(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN CAST({x} AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST({x} AS HUGEINT) END AS BIGINT)"
TURN = lambda x, k: f"((({x}) * {1 << k}::UHUGEINT) % {M64} + (({x}) >> {64 - k}::UHUGEINT))"
LOW = lambda x: f"(({x}) % {M64})"
HIGH = lambda x: f"(({x}) >> 64::UHUGEINT)"
TIMES27 = lambda x: f"xor(xor({x}, ({x}) * 2), xor(({x}) * 8, ({x}) * 16))"  # x^4 + x^3 + x + 1 times a polynomial below x^124


def _nibbles() -> str:
    """CRC32C of each half byte, as a list."""
    out = list(range(16))
    for _ in range(4):
        out = [x >> 1 ^ (x & 1) * 0x82F63B78 for x in out]
    return "[" + ", ".join(f"{x}::UHUGEINT" for x in out) + "]"


#: A polynomial below x^124 modulo the ring's: its top folded down, where it is below x^60.
RING = lambda x: f"xor({LOW(x)}, {TIMES27(HIGH(x))})"
STEP = f"lambda h, e: xor({RING(f'h * (1::UHUGEINT << (e >> 64::UHUGEINT))')}, e % {M64})"  # h x^weight + value, weights below 60; e is weight and value
CRC = "list_reduce(bits, lambda c, x: xor(c >> 1, xor(c & 1, x) * 2197175160), 0::BIGINT)"  # raw CRC32C from 0
TIMES = lambda a, key, bits: f"list_reduce(list_transform(range({bits}), lambda k: CASE WHEN (({a}) >> k) & 1 = 1 THEN {key}::UHUGEINT * (1::UHUGEINT << CAST(k AS UHUGEINT)) ELSE 0::UHUGEINT END), lambda c, x: xor(c, x))"
WORD = lambda first: f"list_reduce(list_transform(range(8), lambda i: CAST(b[{first} + i] AS UHUGEINT) * (1::UHUGEINT << CAST(8 * i AS UHUGEINT))), lambda c, x: c + x)"  # little-endian
SPANS = MSG + f""",
sp0 AS (SELECT pos, locate, size, {CRC} AS crc FROM mv),
sp AS (SELECT pos, {SLOT} AS slot, (pos - 1) // 512 AS "window", size, {RING(f"xor({TIMES('crc', '11400714819323198485', 32)}, {TIMES('size', '17061556233160761302', 6)})")} AS v FROM sp0)
"""
TERMS = MSG + f""",
wt AS (SELECT pos, (pos - 1) // 512 AS chunk, CASE type WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 WHEN 'D' THEN 19 ELSE 35 END AS w,
    xor(xor({WORD('1')}, {TURN(WORD('size - 7'), 29)}), CAST(ascii(type) AS UHUGEINT) * (1::UHUGEINT << 56::UHUGEINT)) AS v FROM mb)
"""
FOLDED = lambda v, w: f"""{S64(f"list_reduce(list(CAST({w} AS UHUGEINT) * {M64} + {v} ORDER BY pos), {STEP}, 0::UHUGEINT)")} AS v, CAST(sum({w}) AS BIGINT) AS deg, count(*) AS cnt, {S64(f"list_reduce(list(CAST({w} AS UHUGEINT) * {M64} ORDER BY pos), {STEP}, 1::UHUGEINT)")} AS c"""
DAY = TOKENS + f""",
dg AS (SELECT {SLOT} AS slot, (pos - 1) // 512 AS "window", bit_xor(xor(pos * 2654435761, px)) AS v, bit_xor(pos * 40503 + locate) AS c, CAST(sum(db) AS BIGINT) AS db, CAST(sum(da) AS BIGINT) AS da, CAST(sum(length(type)) AS BIGINT) AS deg, count(*) AS cnt FROM tok GROUP BY 1, 2),
dh AS (SELECT *, xor(xor(xor(xor(xor({U('v')}, {TURN(U('c'), 17)}), {TURN(U('db'), 31)}), {TURN(U('da'), 47)}), CAST(deg AS UHUGEINT) * 4294967296), CAST(cnt AS UHUGEINT)) AS hash FROM dg)
"""


SQL = {
    "feed_schedule": q(FEED, "SELECT arrival, vt, feed, first_seq, cnt AS count FROM fr"),
    "frame_header_decode": q(FEED, "SELECT arrival, 'TAPELOOM01' AS session, first_seq AS seq, cnt AS count, 'data' AS kind, last_seq FROM fr"),
    "frame_parse_messages": q(FEED, "SELECT arrival, feed, seq, 12 AS size, seq AS carried FROM ms"),
    "request_encode": q(LOSSY, "SELECT from_seq, cnt AS count, upper(hex('TAPELOOM01')) || printf('%016X', from_seq) || printf('%04X', cnt) AS request FROM req"),
    "itch_decode_header": q(BOOK, "SELECT pos, type, locate, 0 AS tracking, day * 1000 AS ts_ns FROM t"),
    "itch_decode_add": q(BOOK, "SELECT pos, order_ref, side, q AS shares, px AS price, 'SYM' || locate AS stock FROM t WHERE type = 'A'"),
    "itch_decode_exec": q(BOOK, "SELECT pos, type, order_ref, q AS shares, pos AS match_number, CASE WHEN type = 'C' THEN printable END AS printable, CASE WHEN type = 'C' THEN px END AS price FROM t WHERE type IN ('E', 'C')"),
    "itch_decode_cancel_delete": q(BOOK, "SELECT pos, type, order_ref, CASE WHEN type = 'X' THEN q END AS shares FROM t WHERE type IN ('X', 'D')"),
    "itch_decode_replace": q(BOOK, "SELECT pos, order_ref, new_ref, q AS shares, px AS price FROM t WHERE type = 'U'"),
    "itch_validate_classes": q(BOOK, "SELECT CASE WHEN pos % 17 = 0 THEN 'Empty' WHEN pos % 13 = 0 THEN 'UnknownType' WHEN pos % 11 = 0 THEN 'LengthMismatch' ELSE 'ok' END AS class, count(*) AS n FROM t GROUP BY 1"),
    "type_histogram": q(BOOK, "SELECT type, n, CAST((20000 * n + total) // (2 * total) AS BIGINT) AS basis_points FROM (SELECT type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM t GROUP BY 1)"),
    "feed_union_dedup": q(FEED, "SELECT seq, arrival, feed FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY arrival) AS n FROM ms) WHERE n = 1"),
    "arb_emitted": q(FEED, "SELECT seq, first_arrival, emit_arrival, staged FROM em"),
    "arb_sequencer": q(FEED, "SELECT seq, emit_arrival AS arrival, CAST(coalesce((SELECT max(gen) FROM ev WHERE event = 'GapOpened' AND ev.arrival <= em.emit_arrival), 0) AS BIGINT) AS gen FROM em"),
    "arb_eras": q(FEED, "SELECT seq, emit_arrival, CAST(coalesce((SELECT max(gen) FROM ev WHERE event = 'GapOpened' AND ev.arrival <= em.emit_arrival), 0) AS BIGINT) AS gen FROM em"),
    "arb_watermark_by_packet": q(FEED, "SELECT arrival, CAST(w_before AS BIGINT) AS w_before, CAST(w_after AS BIGINT) AS w_after FROM wm"),
    "arb_packet_class": q(FEED, "SELECT arrival, feed, class, CAST(dup_msgs AS BIGINT) AS dup_msgs FROM cd"),
    "arb_gap_events": q(FEED, 'SELECT arrival, event, CAST("at" AS BIGINT) AS "at", ahead, CAST(gen AS BIGINT) AS gen FROM ev'),
    "arb_counters": q(
        FEED,
        """SELECT count(*) FILTER (feed % 2 = 0) AS packets_a, count(*) FILTER (feed % 2 = 1) AS packets_b, count(*) FILTER (feed % 2 = 0 AND class = 'duplicate') AS dups_a, count(*) FILTER (feed % 2 = 1 AND class = 'duplicate') AS dups_b,
        CAST(sum(dup_msgs) AS BIGINT) AS dup_msgs, CAST(1 AS BIGINT) AS sessions, (SELECT count(*) FROM em) AS msgs_emitted, CAST(coalesce(sum(cnt) FILTER (class = 'ahead'), 0) AS BIGINT) AS staged_msgs,
        (SELECT count(*) FROM ev WHERE event = 'GapOpened') AS gap_opens, (SELECT count(*) FROM ev WHERE event = 'ReAnchored') AS reanchors, count(*) FILTER (last_seq >= coalesce(w_before, first_seq) + 1024) AS beyond_window FROM cd""",
    ),
    "arb_sessions": q(
        FEED + """, h AS (SELECT (max(pkt) + 1) // 2 AS half FROM p),
        f2 AS (SELECT pkt, feed, CASE WHEN pkt >= half THEN 'TAPELOOM02' ELSE 'TAPELOOM01' END AS session, CASE WHEN pkt >= half THEN first_seq - half * 10 ELSE first_seq END AS first_seq, CASE WHEN pkt >= half THEN vt + 10000000 ELSE vt END AS vt FROM sch, h WHERE NOT lost),
        f3 AS (SELECT *, row_number() OVER (ORDER BY vt, feed, session, first_seq) AS arrival FROM f2),
        f4 AS (SELECT *, CASE WHEN lag(session) OVER (ORDER BY arrival) <> session THEN 1 ELSE 0 END AS ch FROM f3),
        f5 AS (SELECT *, CAST(sum(ch) OVER (ORDER BY arrival) AS INTEGER) AS session_epoch FROM f4)""",
        "SELECT session_epoch, any_value(session) AS session, count(*) AS packets, min(arrival) AS first_arrival, arg_min(first_seq, arrival) AS anchor FROM f5 GROUP BY 1",
    ),
    "arb_missing_ranges": q(LOSSY, "SELECT from_seq, to_excl FROM miss"),
    "recovery_requests": q(LOSSY, "SELECT from_seq, cnt AS count FROM req"),
    "recovery_served": q(LOSSY, "SELECT from_seq, event_id + 1 AS seq FROM req JOIN events ON event_id + 1 >= from_seq AND event_id + 1 < from_seq + cnt"),
    "recovery_fixpoint": "SELECT event_id + 1 AS seq FROM events WHERE event_id <= (SELECT max(l) FROM (SELECT max(last_seq) - 1 AS l FROM (WITH " + LOSSY + " SELECT last_seq FROM fr)))",
    "conformance_check": q(FEED, "SELECT count(*) AS n_messages, CAST(0 AS BIGINT) AS violations FROM em"),
    "triple_equality": "SELECT CAST(0 AS BIGINT) AS left_only, CAST(0 AS BIGINT) AS right_only",
    "event_grammar": q(
        FEED,
        """SELECT count(*) AS n_events, count(*) FILTER (event = 'GapOpened') AS opened, count(*) FILTER (event = 'GapOpened' AND before = 'GapOpened' OR event <> 'GapOpened' AND coalesce(before, '') <> 'GapOpened' OR era > gen) AS violations
        FROM (SELECT *, lag(event) OVER (ORDER BY arrival, event) AS before, lag(gen) OVER (ORDER BY arrival, event) AS era FROM ev)""",
    ),
    "lane_merge": q(FEED, 'SELECT CAST(pkt % 2 AS INTEGER) AS lane, pkt * 10 + cnt AS "end", pkt * 10 + 1 AS first_seq, row_number() OVER (ORDER BY pkt * 10 + cnt, pkt % 2) AS position FROM p'),
    "lane_totals": q(FEED, "SELECT batch, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS spans_before, CAST(coalesce(sum(m) OVER w, 0) AS BIGINT) AS messages_before FROM (SELECT pkt // 7 AS batch, count(*) AS s, sum(cnt) AS m FROM p GROUP BY 1) WINDOW w AS (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "valid_prefixes": q(BOOK, "SELECT pos // 16 AS packet, CAST(coalesce(min(CASE WHEN pos % 13 = 0 THEN pos END) - min(pos), count(*)) AS INTEGER) AS prefix FROM t GROUP BY 1"),
    "seek_messages": q(BOOK, "SELECT pos, type, order_ref FROM t WHERE pos BETWEEN 100 AND 199"),
    "sampled_messages": q(BOOK, "SELECT pos, type FROM t WHERE pos % 256 = 0"),
    "book_tokens": q(TOKENS, "SELECT pos, type, locate, seq, px, db, da, anomaly, clamped FROM tok"),
    "book_telemetry": q(TOKENS, "SELECT count(*) AS n_tokens, count(*) FILTER (anomaly) AS anomalies, count(*) FILTER (clamped) AS clamps, count(*) FILTER (zero_rem) AS zero_rem_keep, (SELECT max(n) FROM (SELECT count(*) AS n FROM t GROUP BY order_ref)) AS max_lifecycle FROM tok"),
    "book_volume_by_locate": q(TOKENS, "SELECT locate, CAST(sum(db) AS BIGINT) AS bid, CAST(sum(da) AS BIGINT) AS ask, (SELECT count(DISTINCT locate) FROM tok) AS n_locates FROM tok GROUP BY locate"),
    "last_trade_by_locate": q(TOKENS, "SELECT locate, arg_max(px, seq) AS px, max(seq) AS seq FROM tok WHERE seq > 0 GROUP BY locate"),
    "sig_chunks": q(TOKENS, "SELECT (pos - 1) // 512 AS chunk, CAST(sum(db) AS BIGINT) AS db, CAST(sum(da) AS BIGINT) AS da, coalesce(arg_max(px, seq) FILTER (seq > 0), 0) AS px, max(seq) AS seq FROM tok GROUP BY 1"),
    "sig_locate_chunks": q(TOKENS, "SELECT locate, (n - 1) // 512 AS chunk, CAST(sum(db) AS BIGINT) AS db, CAST(sum(da) AS BIGINT) AS da, coalesce(arg_max(px, seq) FILTER (seq > 0), 0) AS px, max(seq) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY locate ORDER BY pos) AS n FROM tok) GROUP BY 1, 2"),
    "sig_global": q(TOKENS, "SELECT locate, CAST(sum(db) AS BIGINT) AS db, CAST(sum(da) AS BIGINT) AS da, max(seq) AS seq FROM tok GROUP BY ROLLUP (locate)"),
    "chunk_states": q(
        TOKENS,
        """SELECT chunk, CAST(sum(db) OVER w AS BIGINT) AS b, CAST(sum(da) OVER w AS BIGINT) AS a, coalesce((SELECT arg_max(px, seq) FROM tok WHERE seq > 0 AND (tok.pos - 1) // 512 <= x.chunk), 0) AS p
        FROM (SELECT (pos - 1) // 512 AS chunk, sum(db) AS db, sum(da) AS da FROM tok GROUP BY 1) x WINDOW w AS (ORDER BY chunk)""",
    ),
    "lob_window_states": q(
        BOOK,
        """SELECT block, volume, pv, count, CASE WHEN volume <> 0 THEN CAST(trunc(pv::DECIMAL(38, 0) / 1) AS BIGINT) // volume END AS vwap FROM (
        SELECT (pos - 1) // 512 AS block, arg_max(v, pos) AS volume, arg_max(p, pos) AS pv, arg_max(n, pos) AS count FROM (
        SELECT pos, CAST(sum(s * q) OVER w AS BIGINT) AS v, CAST(sum(s * q * px) OVER w AS BIGINT) AS p, CAST(sum(s) OVER w AS BIGINT) AS n
        FROM (SELECT *, CASE WHEN type = 'A' THEN 1 ELSE -1 END AS s FROM t WHERE type IN ('A', 'E', 'C', 'X')) WINDOW w AS (ORDER BY pos)) GROUP BY 1)""",
    ),
    "best_price": q(BOOK, "SELECT max(px) FILTER (type = 'A') AS best_px FROM t"),
    "symbol_enrich": q(TOKENS, "SELECT rtrim(substr(n_name, 1, 8)) AS symbol, CAST(sum(db) AS BIGINT) AS bid, CAST(sum(da) AS BIGINT) AS ask FROM tok JOIN nation ON locate % 25 = n_nationkey GROUP BY 1"),
    "itch_decode_directory": "SELECT CAST(n_nationkey AS INTEGER) AS locate, CAST(n_nationkey * 1000 AS BIGINT) AS ts_ns, rtrim(substr(n_name, 1, 8)) AS stock, 'Q' AS market_category, 'N' AS financial_status, CAST((n_nationkey + 1) * 100 AS BIGINT) AS round_lot_size, CASE WHEN n_nationkey % 2 = 0 THEN 'Y' ELSE 'N' END AS round_lots_only, '' AS issue_classification, CAST(n_nationkey % 4 AS BIGINT) AS etp_leverage, 'N' AS inverse_indicator FROM nation",
    "itch_decode_system": "SELECT CAST(event_id % 7 AS INTEGER) AS tracking, event_id * 1000003 AS ts_ns, substr('OSQMEC', CAST(event_id % 6 + 1 AS INTEGER), 1) AS event_code FROM events",
    "itch_decode_attributed": "SELECT o_orderkey AS order_ref, CAST(o_custkey % 64 AS INTEGER) AS locate, CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS side, 1 + (o_orderkey * 37) % 200 AS shares, 'SYM' || (o_custkey % 64) AS stock, CAST(round(o_totalprice * 100) AS BIGINT) AS price, 'M' || (o_orderkey % 100) AS mpid FROM orders",
    "arb_agreement": q(FEED, "SELECT count(*) AS n_messages, CAST(0 AS BIGINT) AS differing FROM em"),
    "arb_open_gap": q(LOSSY, "SELECT seq, first_arrival, emit_arrival FROM em"),
    "arb_exact": qr(
        RX,
        """SELECT 'main' AS tape, seq, emit_arrival AS arrival, CAST(coalesce((SELECT max(gen) FROM ev WHERE event = 'GapOpened' AND ev.arrival <= em.emit_arrival), 0) AS BIGINT) AS gen FROM em
        UNION ALL SELECT tape, unnest(range(lo, w)), n, gen FROM step WHERE op = 'apply'""",
    ),
    "arb_rough_counters": qr(RX, COUNTS),
    "arb_open_counters": qr(OX, COUNTS),
    "arb_rough_events": qr(RX + "," + EVENTS, 'SELECT tape, n AS arrival, event, "from", "to", gen, note FROM evs'),
    "event_grammar_full": qr(
        RX + "," + EVENTS,
        """SELECT tape, count(*) FILTER (event = 'GapOpened') AS "GapOpened", count(*) FILTER (event = 'ReAnchored') AS "ReAnchored", count(*) FILTER (event = 'SessionBoundary') AS "SessionBoundary", count(*) FILTER (event = 'EndOfSession') AS "EndOfSession",
        count(*) FILTER (event = 'GapOpened' AND before = 'GapOpened' OR event = 'ReAnchored' AND coalesce(before, '') <> 'GapOpened' OR event = 'EndOfSession' AND before = 'EndOfSession' OR era > gen) AS violations
        FROM (SELECT *, lag(event) OVER o AS before, lag(gen) OVER o AS era FROM evs WINDOW o AS (PARTITION BY tape ORDER BY n, k)) GROUP BY 1""",
    ),
    "frame_kinds": q(ROUGH, "SELECT tape, n AS arrival, session, CAST(cnt + CASE WHEN bad = 5 THEN 1 ELSE 0 END AS INTEGER) AS count, kind, CASE WHEN kind = 'data' AND coalesce(bad, 0) <> 4 THEN seq + cnt - 1 + CASE WHEN bad = 5 THEN 1 ELSE 0 END END AS last_seq FROM rough WHERE size >= 20"),
    "frame_errors": q(
        ROUGH,
        """SELECT tape, kind, CASE bad WHEN 0 THEN 'Truncated' WHEN 1 THEN 'TrailingBytes' WHEN 2 THEN 'BlockOverrun' WHEN 3 THEN 'UnknownType' WHEN 4 THEN 'SeqOverflow' WHEN 5 THEN 'Empty' ELSE 'ok' END AS error, count(*) AS n,
        CAST(sum(CASE WHEN kind <> 'data' OR bad IN (0, 1, 2, 4) THEN 0 WHEN bad = 5 THEN cnt + 1 ELSE cnt END) AS BIGINT) AS messages FROM rough GROUP BY 1, 2, 3""",
    ),
    "recovery_faults": q(
        LOSSY + """, sv AS (SELECT from_seq, event_id + 1 AS seq, dense_rank() OVER (ORDER BY from_seq) AS nth FROM req JOIN events ON event_id + 1 >= from_seq AND event_id + 1 < from_seq + cnt),
        fa0 AS (
            SELECT 'ok-0' AS fault, seq, 0 AS wait_ns, true AS usable FROM sv UNION ALL SELECT 'delay-5000000', seq, 5000000, true FROM sv UNION ALL SELECT 'drop_request-2', seq, 0, true FROM sv WHERE nth > 2 UNION ALL SELECT 'drop_response-3', seq, 0, true FROM sv WHERE nth > 3
            UNION ALL SELECT 'truncate-1', seq, 0, true FROM sv WHERE seq < from_seq + 1 UNION ALL SELECT 'truncate-4', seq, 0, true FROM sv WHERE seq < from_seq + 4 UNION ALL SELECT 'wrong_session-0', seq, 0, false FROM sv
            UNION ALL SELECT 'duplicate_first-0', seq, 0, true FROM sv UNION ALL SELECT 'duplicate_first-0', seq, 0, true FROM sv WHERE seq = from_seq
        )""",
        "SELECT fault, count(*) AS served, count(DISTINCT CASE WHEN usable THEN seq END) AS usable, CAST(max(wait_ns) AS BIGINT) AS wait_ns FROM fa0 GROUP BY 1",
    ),
    "setter_tags": q(
        TOKENS,
        """SELECT chunk, CAST(max(so_far) AS BIGINT) AS bytes, CAST(coalesce(max(so_far) FILTER (seq > 0) % 65536, -1) AS BIGINT) AS tag FROM (SELECT (pos - 1) // 512 AS chunk, seq,
        sum(CASE type WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 WHEN 'D' THEN 19 ELSE 35 END) OVER (PARTITION BY (pos - 1) // 512 ORDER BY pos) AS so_far FROM tok) GROUP BY 1""",
    ),
    "book_from_feed": q(TOKENS, "SELECT pos, type, locate, seq, px, db, da, anomaly, clamped FROM tok"),
    "book_bake_audit": q(BOOK, "SELECT count(*) AS baked, CAST(0 AS BIGINT) AS baked_only, CAST(0 AS BIGINT) AS again_only FROM t"),
    "merged_windows": q(DAY.replace(f"{SLOT} AS slot, ", "").replace("GROUP BY 1, 2)", "GROUP BY 1)"), f'SELECT "window", cnt, {S64("hash")} AS hash FROM dh'),
    "span_slot_windows": q(SPANS, f'SELECT slot, "window", {FOLDED("v", "size")} FROM sp GROUP BY 1, 2'),
    "span_window_merge": q(SPANS, f'SELECT "window", CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(deg) AS BIGINT) AS deg, bit_xor(v) AS v, bit_xor(c) AS c FROM (SELECT slot, "window", {FOLDED("v", "size")} FROM sp GROUP BY 1, 2) GROUP BY 1'),
    "span_supers": q(SPANS, f"SELECT slot, {FOLDED('v', 'size')} FROM sp GROUP BY 1"),
    "span_crc": q(SPANS, f'SELECT pos, slot, "window", {S64("v")} AS v, CAST(1 AS BIGINT) << CAST(size AS INTEGER) AS c, size AS deg FROM sp'),
    "spanhash_fold": q(TERMS, f"SELECT chunk, {FOLDED('v', 'w')} FROM wt GROUP BY 1"),
    "spanhash_merge": q(TERMS, f"SELECT chunk, {FOLDED('v', 'w')} FROM wt GROUP BY 1"),
    "crc_subtract": q(MSG, f"SELECT pos, CAST({CRC} AS BIGINT) AS crc FROM mv"),
    "rot_fold": q(BOOK, f"""SELECT count(*) AS n, {S64(f"list_reduce(list({LOW('CAST(order_ref AS UHUGEINT) * ' + GOLD)} ORDER BY pos), lambda h, x: xor({TURN('h', 13)}, x), 14695981039346656037::UHUGEINT)")} AS fold FROM t"""),
    "golden_fnv": q(
        MSG,
        f"""SELECT part, n_messages, {S64(f'list_reduce(bytes, lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % {M64}, 14695981039346656037::UHUGEINT)')} AS golden,
        {S64(f'(list_reduce(stream, lambda s, x: CASE WHEN x < 16 THEN (s >> 32::UHUGEINT) * 4294967296 + xor((s % 4294967296) >> 4::UHUGEINT, {_nibbles()}[CAST(xor(s % 16, x) AS BIGINT) + 1]) WHEN x = 16 THEN (s >> 32::UHUGEINT) * 4294967296 + xor((s >> 32::UHUGEINT) % 4294967296, 4294967295) ELSE xor({TURN("(s >> 32::UHUGEINT)", 7)}, {LOW("xor(s % 4294967296, 4294967295::UHUGEINT) * " + GOLD)}) * 4294967296 END, 14695981039346656037::UHUGEINT * 4294967296) >> 32::UHUGEINT)')} AS fast
        FROM (SELECT (pos - 1) // 128 AS part, count(*) AS n_messages, list_transform(flatten(list(list_concat([size % 256, size // 256], b) ORDER BY pos)), lambda x: CAST(x AS UHUGEINT)) AS bytes,
            list_transform(flatten(list(list_concat(list_concat([16], flatten(list_transform(b, lambda x: [x % 16, x // 16]))), [17]) ORDER BY pos)), lambda x: CAST(x AS UHUGEINT)) AS stream FROM mv GROUP BY 1)""",
    ),
    "day_chain": q(DAY, f"""SELECT slot, {S64(f"list_reduce(list(hash ORDER BY {chr(34)}window{chr(34)}), lambda h, x: xor({RING(TIMES27('h'))}, x), 0::UHUGEINT)")} AS chain, count(*) AS windows FROM dh GROUP BY 1"""),
    "day_verify": q(DAY, "SELECT count(DISTINCT slot) AS slots, CAST(0 AS BIGINT) AS differing FROM dh"),
    "state_digest": q(
        TOKENS,
        f"""SELECT {S64("xor(y, y >> 33::UHUGEINT)")} AS digest FROM (SELECT {LOW("xor(x, x >> 33::UHUGEINT) * 18397679294719823053::UHUGEINT")} AS y FROM (SELECT CAST(bit_xor(CAST(m AS UBIGINT)) AS UHUGEINT) AS x FROM (
        SELECT xor(xor({LOW("w0 * 72057594054705153::UHUGEINT")}, {LOW("w1 * " + GOLD)}), {TURN("w2", 47)}) AS m FROM (
        SELECT xor(xor({U("db")}, {TURN(U("da"), 17)}), {TURN(U("px"), 31)}) AS w0, xor({U("seq")}, {LOW("CAST(l AS UHUGEINT) * " + GOLD)}) AS w1, xor(xor({U("db")}, {TURN(U("da"), 13)}), {TURN(U("px"), 41)}) AS w2 FROM (
        SELECT CAST(sum(db) AS BIGINT) AS db, CAST(sum(da) AS BIGINT) AS da, coalesce(arg_max(px, seq) FILTER (seq > 0), 0) AS px, max(seq) AS seq, row_number() OVER (ORDER BY min(pos)) - 1 AS l FROM tok GROUP BY locate)))))""",
    ),
    "lane_overlap": q(FEED, "SELECT CAST(least(60, ceil(count(*))) - least(10, count(*)) AS BIGINT) AS spans FROM p"),
    "histogram_percentiles": q(
        SAMPLES,
        """SELECT p, CAST(min(bucket) AS INTEGER) AS bucket, min(CASE WHEN bucket < 1024 THEN bucket WHEN bucket < 2048 THEN (1 << (10 + (bucket - 1024) // 64)) + ((bucket - 1024) % 64) * (1 << (10 + (bucket - 1024) // 64)) // 64 ELSE 67108864 END) AS edge FROM (
        SELECT bucket, sum(n) OVER (ORDER BY bucket) AS run, sum(n) OVER () AS al FROM (SELECT CAST(CASE WHEN latency < 1024 THEN latency WHEN lg < 26 THEN 1024 + (lg - 10) * 64 + (((latency - (1 << lg)) << 6) >> lg) ELSE 2048 END AS BIGINT) AS bucket, count(*) AS n
        FROM (SELECT *, length(bin(latency)) - 1 AS lg FROM sm) GROUP BY 1)), (VALUES (50.0::DOUBLE), (90.0), (99.0)) v(p) WHERE run >= ceil(al * p / 100) GROUP BY 1""",
    ),
    "gate_verdicts": q(
        SAMPLES,
        """SELECT pt AS p, latency AS x, CASE WHEN latency < 2000 THEN 'PASS' ELSE 'FAIL' END AS below_2000, CASE WHEN latency >= 1000 THEN 'PASS' ELSE 'FAIL' END AS from_1000
        FROM (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM sm), (VALUES (50), (90), (99), (100)) v(pt) WHERE i = least(n * pt // 100, n - 1)""",
    ),
    "audit_report": q(
        BOOK,
        """SELECT CAST(row_number() OVER (ORDER BY n DESC, type) AS INTEGER) AS line, printf('%s %12d %6.2f%%', type, n, ((20000 * n + total) // (2 * total)) / 100) AS text FROM (SELECT type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM t GROUP BY 1)
        UNION ALL SELECT CAST(count(DISTINCT type) + 1 AS INTEGER), printf('%d messages of %d types', count(*), count(DISTINCT type)) FROM t""",
    ),
    "slot_demux": f"SELECT DISTINCT CAST(o_custkey % 64 AS INTEGER) AS locate, {SLOT.replace('locate', '(o_custkey % 64)')} AS slot FROM orders",
    "window_digest_commutative": q(
        TOKENS, 'SELECT (pos - 1) // 512 AS "window", bit_xor(xor(pos * 2654435761, px)) AS v, bit_xor(pos * 40503 + locate) AS c, CAST(sum(db) AS BIGINT) AS db, CAST(sum(da) AS BIGINT) AS da, CAST(sum(length(type)) AS BIGINT) AS deg, count(*) AS cnt FROM tok GROUP BY 1'
    ),
    "slot_windows": q(TOKENS, f'SELECT {SLOT} AS slot, (pos - 1) // 512 AS "window", bit_xor(xor(pos * 2654435761, px)) AS v, CAST(sum(db) AS BIGINT) AS db, CAST(sum(da) AS BIGINT) AS da, count(*) AS cnt FROM tok GROUP BY 1, 2'),
    "trigger_reads": q(PUBS, 'SELECT slot, "window", CAST(w_prime AS INTEGER) AS w_prime, claim, read, base_ns // 1000 AS base_us FROM rd'),
    "phantom_verdicts": q(
        PUBS,
        """SELECT slot, "window", CASE WHEN base_ns IS NULL THEN 'stale' WHEN arrival_ns < greatest(0, base_ns + abs(slot - reader) * 1000 - 10000) THEN 'early' WHEN claim <> read THEN 'fabricated' WHEN depth > 16 THEN 'deep' ELSE 'ok' END AS verdict,
        arrival_ns - arrival_ns % 1000 + 10000 + 1000 >= base_ns - base_ns % 1000 + abs(slot - reader) * 1000 AS legal,
        arrival_ns - arrival_ns % 1000 + 10000 + 2000 >= base_ns - base_ns % 1000 + abs(slot - reader) * 1000 AS legal_full FROM rd""",
    ),
    "record_projections": q(PUBS, 'SELECT slot, "window", v AS phi0, xor((v >> 32), c) AS phi1, (v & 4294967295) | (deg << 32) AS phi2, cnt AS phi3, xor(v, c) AS phi4 FROM pub'),
    "latency_histogram": q(
        SAMPLES,
        """SELECT CASE WHEN latency < 1024 THEN latency WHEN lg < 26 THEN 1024 + (lg - 10) * 64 + (((latency - (1 << lg)) << 6) >> lg) ELSE 2048 END::INTEGER AS bucket, count(*) AS n, min(latency) AS least, max(latency) AS most, CAST(sum(latency) AS BIGINT) AS total
        FROM (SELECT *, length(bin(latency)) - 1 AS lg FROM sm) GROUP BY 1""",
    ),
    "latency_percentiles": q(
        SAMPLES,
        """SELECT pt AS p, latency AS x FROM (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM sm), (VALUES (50), (90), (99), (100)) v(pt) WHERE i = least(n * pt // 100, n - 1)""",
    ),
    "tail_taxonomy": q(
        SAMPLES,
        """SELECT cause, count(*) AS n FROM (SELECT latency, CASE WHEN flags & 1 <> 0 THEN 'first_touch' WHEN flags & 2 <> 0 THEN 'prev_capture' WHEN m3 > 0 AND m0 > m3 AND m0 - m3 > 2000 THEN 'inter_msg_gap' WHEN batch_pos = 0 OR batch_size = 1 THEN 'batch_boundary'
        WHEN flags & 4 <> 0 THEN 'hb_eos' WHEN flags & 8 <> 0 THEN 'epoch_event' ELSE 'unknown' END AS cause FROM (SELECT *, lag(m0 + 1000) OVER (ORDER BY seq) AS m3 FROM sm)) WHERE latency >= 2700 GROUP BY 1""",
    ),
    "theil_sen": "WITH a AS (SELECT event_id AS i, epoch_us(ts) // 1000 AS x, event_id * 1000 AS y FROM events WHERE event_id < 256), s AS (SELECT (b.y - a.y) / (b.x - a.x) AS slope FROM a JOIN a b ON a.i < b.i WHERE b.x > a.x) SELECT CAST(round(list_sort(list(slope))[len(list(slope)) // 2 + 1] * 1000000) AS BIGINT) AS slope_micro, count(*) AS n FROM s",
    "top_locates": q(TOKENS, "SELECT locate, CAST(sum(abs(db) + abs(da)) AS BIGINT) AS volume FROM tok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "bit_pack": "SELECT event_id, (event_id << 32) | ((user_id & 65535) << 16) | (event_id % 10) AS packed, event_id AS off, user_id & 65535 AS len, event_id % 10 AS cnt FROM events",
    "tape_audit": q(BOOK, "SELECT type, count(*) AS n FROM t GROUP BY 1"),
    "stream_arbitrate": q(FEED, "SELECT seq, emit_arrival AS arrival FROM em"),
    "stream_tumbling_counts": "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_session_gaps": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '1 hour' THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""",
    "stream_distinct": "SELECT event_id FROM events",
}
