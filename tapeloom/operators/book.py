"""Order book: references resolved as of their position, tokens, volumes, last trades, folds and states.

No hash table: rows of an order reference are ordered by position; lives begin at births, and what remains of an order
is its shares less what was executed or cancelled before, never below zero. Replacements make new references only if
the old one was alive, which is settled by a fixpoint over births.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.binary import wrapping_sum, wrapping_times
from tapeloom.functions.ordering import running

CHUNK = 512
#: Messages that refer to an order; prints (P, Q) only set a price, all others leave the book as it is.
REFERRING = ("A", "F", "E", "C", "X", "D", "U")


def _rows(tape: DataFrame) -> DataFrame:
    """tape as rows by reference: a replacement is an end of the old reference (role 0) and a birth of the new one (role 1)."""
    common = ["pos", "type", "locate", "side", "q", "px", "printable"]
    tape = tape.where(F.col("type").isin(*REFERRING))
    own = tape.select(F.col("order_ref").alias("ref"), F.when(F.col("type").isin("A", "F"), 1).otherwise(0).alias("role"), *common, F.lit(None).cast("bigint").alias("parent"))
    new = tape.where("type = 'U'").select(F.col("new_ref").alias("ref"), F.lit(1).alias("role"), *common, F.col("order_ref").alias("parent"))
    return own.unionByName(new)


def _lives(rows: DataFrame) -> DataFrame:
    """rows plus life (how many births so far), ended, taken, shares, own_px, own_side, alive and rem."""
    by = Window.partitionBy("ref").orderBy("pos", "role")
    rows = rows.withColumn("life", F.sum("role").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ((F.col("role") == 0) & F.col("type").isin("D", "U")).cast("int")
    takes = F.when((F.col("role") == 0) & F.col("type").isin("E", "C", "X"), F.col("q")).otherwise(0)
    life = Window.partitionBy("ref", "life").orderBy("pos", "role")
    before, so_far = life.rowsBetween(Window.unboundedPreceding, -1), life.rowsBetween(Window.unboundedPreceding, 0)
    born = F.col("role") == 1
    rows = rows.withColumns(
        {
            "ended": F.coalesce(F.max(ends).over(before), F.lit(0)),
            "taken": F.coalesce(F.sum(takes).over(before), F.lit(0)),
            "shares": F.max(F.when(born, F.col("q"))).over(so_far),  # a life's first row is its birth
            "own_px": F.max(F.when(born, F.col("px"))).over(so_far),
            "own_side": F.max(F.when(born, F.col("side"))).over(so_far),
        }
    )
    rows = rows.withColumn("alive", (F.col("life") > 0) & (F.col("ended") == 0))
    return rows.withColumn("rem", F.when(F.col("alive"), F.greatest(F.lit(0), F.col("shares") - F.col("taken"))))


def _settled(rows: DataFrame) -> DataFrame:
    """Lives in which no birth comes from a replacement of a dead order.

    All references are resolved once. Births by dead replacements are taken out and the references they would have made
    resolved anew, until a round finds no more of them; a round touches only such references and is checkpointed."""
    done = _lives(rows).checkpoint()
    found = done.where("role = 0 AND type = 'U' AND NOT alive").select("pos").checkpoint()
    dead, changed = found, None
    while not found.isEmpty():  # a round only adds to the dead, so this ends
        touched = rows.where("role = 1 AND type = 'U'").join(found, "pos", "left_semi").select("ref").distinct()
        touched = touched if changed is None else touched.unionByName(changed).distinct()
        changed = touched.checkpoint()
        again = _lives(rows.join(changed, "ref", "left_semi").join(dead.withColumn("role", F.lit(1)), ["pos", "role"], "left_anti")).checkpoint()
        now = again.where("role = 0 AND type = 'U' AND NOT alive").select("pos")
        found = now.join(dead, "pos", "left_anti").checkpoint()
        dead = dead.unionByName(found).checkpoint()
    return done if changed is None else done.join(changed, "ref", "left_anti").unionByName(again)


def resolve(tape: DataFrame) -> DataFrame:
    """Rows by reference with life, alive, rem and side."""
    rows = _settled(_rows(tape)).checkpoint()
    # Sides: an add's own; a replacement inherits through the chain of its old references. A round for each link of the longest chain.
    old = rows.where("role = 0 AND type = 'U' AND alive").select("pos", F.col("ref").alias("_ref"), F.col("life").alias("_life"), F.col("own_side").alias("_side"))
    births = rows.where("role = 1 AND parent IS NOT NULL").select("ref", "life", "pos").join(old, "pos").drop("pos").checkpoint()
    sides = births.where("_side IS NOT NULL").select("ref", "life", F.col("_side").alias("side"))
    newest, waiting = sides, births.where("_side IS NULL").drop("_side")
    while not waiting.isEmpty():
        to = newest.select(F.col("ref").alias("_ref"), F.col("life").alias("_life"), "side")
        newest = waiting.join(to, ["_ref", "_life"]).select("ref", "life", "side").checkpoint()
        if newest.isEmpty():
            break  # what is left descends from no add
        sides = sides.unionByName(newest)
        waiting = waiting.join(newest, ["ref", "life"], "left_anti").checkpoint()
    inherited = sides.withColumnRenamed("side", "_side")
    return rows.join(inherited, ["ref", "life"], "left").withColumn("side", F.coalesce("own_side", "_side")).drop("own_side", "_side")


def tokens(tape: DataFrame) -> DataFrame:
    """One row a message: pos, type, locate, seq (0: sets no price), px, db, da, anomaly, clamped, zero_rem."""
    rows = resolve(tape)
    old = rows.where("role = 0 OR type IN ('A', 'F')")
    nq = F.when(F.col("type") == "U", F.col("q"))
    eff = F.least("q", "rem")
    takes = F.col("type").isin("E", "C", "X")
    change = (
        F.when(F.col("type").isin("A", "F"), F.col("q")).when(~F.col("alive"), 0).when(takes, -eff).when(F.col("type") == "D", -F.col("rem")).when(F.col("type") == "U", nq - F.col("rem")).otherwise(0)
    )
    sets = F.col("alive") & ((F.col("type") == "E") | (F.col("type") == "C") & (F.col("printable") == "Y"))
    out = old.select(
        "pos", "type", "locate",
        F.when(sets, F.col("pos")).otherwise(0).alias("seq"),
        F.when(sets, F.when(F.col("type") == "E", F.col("own_px")).otherwise(F.col("px"))).otherwise(0).alias("px"),
        F.when(F.col("side") == "S", 0).otherwise(change).cast("bigint").alias("db"),
        F.when(F.col("side") == "S", change).otherwise(0).cast("bigint").alias("da"),
        (F.col("type").isin("E", "C", "X", "D", "U") & ~F.col("alive")).alias("anomaly"),
        F.coalesce(takes & F.col("alive") & (F.col("q") > F.col("rem")), F.lit(False)).alias("clamped"),
        F.coalesce((F.col("type") == "E") & F.col("alive") & (F.col("q") > F.col("rem")), F.lit(False)).alias("zero_rem"),
    )
    prints = F.col("type").isin("P", "Q")
    rest = tape.where(~F.col("type").isin(*REFERRING)).select(
        "pos", "type", "locate", F.when(prints, F.col("pos")).otherwise(0).alias("seq"), F.when(prints, F.col("px")).otherwise(0).alias("px"), F.lit(0).cast("bigint").alias("db"),
        F.lit(0).cast("bigint").alias("da"), *(F.lit(False).alias(c) for c in ("anomaly", "clamped", "zero_rem")),
    )
    return out.unionByName(rest)


def signature(rows: DataFrame, *by) -> DataFrame:
    """The fold of tokens: sums of the deltas modulo 2^64, price and number of the last that set one (0 if none)."""
    sets = F.col("seq") > 0
    return rows.groupBy(*by).agg(
        wrapping_sum(F.col("db")).alias("db"), wrapping_sum(F.col("da")).alias("da"), F.coalesce(F.max_by(F.when(sets, F.col("px")), F.when(sets, F.col("seq"))), F.lit(0)).alias("px"), F.max("seq").alias("seq")
    )


def chunks(rows: DataFrame) -> DataFrame:
    return signature(rows, F.expr(f"(pos - 1) div {CHUNK}").alias("chunk"))


def by_locate(rows: DataFrame) -> DataFrame:
    return signature(rows, "locate")


def locate_chunks(rows: DataFrame) -> DataFrame:
    """The fold by locate and by chunk of CHUNK tokens within the locate."""
    rows = running(rows, F.expr("pos div 65536"), ["pos"], ["locate"], _n=("sum", F.lit(1).cast("bigint")))
    return signature(rows.withColumn("chunk", F.expr(f"(_n - 1) div {CHUNK}")), "locate", "chunk")


def chunk_states(rows: DataFrame) -> DataFrame:
    """State after each chunk: volumes so far and the last price so far. Chunks are few: a running value over chunk rows."""
    per = chunks(rows)
    out = running(per, F.expr("chunk div 4096"), ["chunk"], b=("wrap", F.col("db")), a=("wrap", F.col("da")), _seq=("max", F.col("seq")))
    prices = per.where("seq > 0").select(F.col("seq").alias("_s"), F.col("px").alias("p"))
    return out.join(prices, F.col("_seq") == F.col("_s"), "left").select("chunk", "b", "a", F.coalesce("p", F.lit(0)).alias("p"))


def tags(rows: DataFrame) -> DataFrame:
    """For each chunk its bytes by the span weights, and the offset (modulo 2^16) after the last message that set a price; -1 if none did."""
    from tapeloom.functions.itch import SPAN_WEIGHT, lookup

    order = Window.partitionBy("chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # CHUNK rows
    rows = rows.select(F.expr(f"(pos - 1) div {CHUNK}").alias("chunk"), "pos", "seq", lookup(SPAN_WEIGHT, F.col("type"), 0).cast("bigint").alias("w"))
    rows = rows.withColumn("so_far", F.sum("w").over(order))
    last = F.max(F.when(F.col("seq") > 0, F.col("so_far")))
    return rows.groupBy("chunk").agg(F.sum("w").alias("bytes"), F.coalesce(last % 65_536, F.lit(-1)).alias("tag"))


def lob_events(tape: DataFrame) -> DataFrame:
    """Add, execution and cancel events: i, kind, px, qty."""
    kind = F.when(F.col("type") == "A", "Add").when(F.col("type").isin("E", "C"), "Exec").when(F.col("type") == "X", "Cancel")
    return tape.select(F.col("pos").alias("i"), kind.alias("kind"), "px", F.col("q").alias("qty")).where("kind IS NOT NULL")


def lob_states(events: DataFrame, block: int = CHUNK) -> DataFrame:
    """State after each block of positions: volume, pv, count and the integer average price (null at volume 0)."""
    sign = F.when(F.col("kind") == "Add", 1).otherwise(-1).cast("bigint")
    worth = wrapping_times(F.col("qty"), F.col("px"))
    worth = F.when(F.col("kind") == "Add", worth).otherwise(-worth)
    sums = events.groupBy(F.expr(f"(i - 1) div {block}").alias("block")).agg(F.sum(sign * F.col("qty")).alias("dv"), wrapping_sum(worth).alias("dpv"), F.sum(sign).alias("dn"))
    out = running(sums, F.expr("block div 4096"), ["block"], volume=("wrap", F.col("dv")), pv=("wrap", F.col("dpv")), count=("sum", F.col("dn")))
    return out.select("block", "volume", "pv", F.col("count").cast("bigint"), F.when(F.col("volume") != 0, F.expr("pv div volume")).cast("bigint").alias("vwap"))


def telemetry(rows: DataFrame, tape: DataFrame) -> DataFrame:
    """Anomalies, clamps, and the longest life in messages of any order reference."""
    most = tape.where(F.col("type").isin(*REFERRING)).groupBy("order_ref").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_lifecycle"))
    sums = rows.agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if("anomaly").alias("anomalies"), F.count_if("clamped").alias("clamps"), F.count_if("zero_rem").alias("zero_rem_keep"))
    return sums.crossJoin(most)  # one row each


def state_digest(rows: DataFrame) -> DataFrame:
    """XOR over locates of a mix of first-appearance number, fold and state; avalanched. Its rotations and factors are fixed values."""
    from tapeloom.functions.binary import rotate_left
    from tapeloom.functions.hashes import GOLDEN, wrapping_product

    signed = lambda x: F.lit(x - (1 << 64) if x >= 1 << 63 else x)
    per = signature(rows, "locate").join(rows.groupBy("locate").agg(F.min("pos").alias("first")), "locate")
    per = per.withColumn("l", F.row_number().over(Window.orderBy("first")) - 1)  # one row for each locate, a 16-bit field
    times = lambda a, k: wrapping_product(a.cast("bigint"), signed(k))
    w0 = F.col("db").bitwiseXOR(rotate_left(F.col("da"), 17)).bitwiseXOR(rotate_left(F.col("px"), 31))
    w1 = F.col("seq").bitwiseXOR(times(F.col("l"), GOLDEN))
    w2 = F.col("db").bitwiseXOR(rotate_left(F.col("da"), 13)).bitwiseXOR(rotate_left(F.col("px"), 41))
    per = per.withColumns({"w0": w0, "w1": w1, "w2": w2})
    mixed = times(F.col("w0"), 0x100000001000001).bitwiseXOR(times(F.col("w1"), GOLDEN)).bitwiseXOR(rotate_left(F.col("w2"), 47))
    total = per.select(mixed.alias("m")).agg(F.bit_xor("m").alias("x"))
    x = F.col("x").bitwiseXOR(F.shiftrightunsigned("x", 33))
    y = total.select(times(x, 0xFF51AFD7ED558CCD).alias("y"))
    return y.select(F.col("y").bitwiseXOR(F.shiftrightunsigned("y", 33)).alias("digest"))
