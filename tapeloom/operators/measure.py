"""Measurement: log-linear histograms, percentiles, tail causes, robust slopes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the histogram: linear buckets, bands of powers of two from 2^10, sub-buckets a band, one for the rest.
LINEAR, BANDS, SUB = 1024, 16, 64
OVERFLOW = LINEAR + BANDS * SUB


def bucket(x: Column) -> Column:
    log = F.length(F.bin(x)) - 1
    sub = F.shiftrightunsigned(F.shiftleft(x - F.expr("1L").cast("bigint") * F.pow(F.lit(2.0), log).cast("bigint"), 6), 0)
    offset = F.floor(sub / F.pow(F.lit(2.0), log)).cast("int")
    return F.when(x < LINEAR, x.cast("int")).when(log < 26, F.lit(LINEAR) + (log - 10) * SUB + offset).otherwise(OVERFLOW).cast("int")


def lower_edge(b: Column) -> Column:
    band, sub = F.floor((b - LINEAR) / SUB), F.pmod(b - LINEAR, F.lit(SUB))
    base = F.pow(F.lit(2.0), band + 10).cast("bigint")
    return F.when(b < LINEAR, b.cast("bigint")).when(b < OVERFLOW, base + F.floor(sub * base / SUB).cast("bigint")).otherwise(F.lit(1 << 26)).cast("bigint")


def histogram(samples: DataFrame, value: str = "latency") -> DataFrame:
    return samples.groupBy(bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).cast("bigint").alias("total"))


def histogram_percentiles(hist: DataFrame, points: list[float]) -> DataFrame:
    """For each point the lower edge of the bucket where the count reaches it; a histogram has at most OVERFLOW + 1 rows."""
    rows = hist.withColumns({"run": F.sum("n").over(Window.orderBy("bucket")), "all": F.sum("n").over(Window.partitionBy())})
    wanted = rows.withColumn("p", F.explode(F.array(*map(F.lit, points)))).where(F.col("run") >= F.ceil(F.col("all") * F.col("p") / 100))
    return wanted.groupBy("p").agg(F.min("bucket").alias("bucket")).select("p", "bucket", lower_edge(F.col("bucket")).alias("edge"))


def exact_percentiles(samples: DataFrame, points: list[float], value: str = "latency") -> DataFrame:
    """The sample at index floor(n * p / 100) of the sorted samples, from counts by value."""
    per = samples.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    from tapeloom.functions.ordering import running

    rows = running(per, F.expr("x div 256"), ["x"], run=("sum", F.col("n")))
    total = per.agg(F.sum("n").alias("all"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("p", F.explode(F.array(*map(F.lit, points))))  # one row
    at = F.least(F.floor(F.col("all") * F.col("p") / 100), F.col("all") - 1)
    return rows.where(F.col("run") > at).groupBy("p").agg(F.min("x").alias("x"))


FIRST_TOUCH, PREV_CAPTURE, HB_EOS, EPOCH_EVENT, GAP = 1, 2, 4, 8, 2000


def tail_causes(samples: DataFrame, threshold: int, bucket_size: int = 65_536) -> DataFrame:
    """Samples at or above the threshold by cause; causes are tried in a fixed order and add up to all."""
    from tapeloom.functions.ordering import running

    rows = running(samples, F.expr(f"seq div {bucket_size}"), ["seq"], inclusive=False, _m3=("max", F.col("m3")))
    flag = lambda k: F.col("flags").bitwiseAND(k) != 0
    gap = F.when((F.col("_m3") > 0) & (F.col("m0") > F.col("_m3")), F.col("m0") - F.col("_m3")).otherwise(0)
    cause = (
        F.when(flag(FIRST_TOUCH), "first_touch").when(flag(PREV_CAPTURE), "prev_capture").when(gap > GAP, "inter_msg_gap").when((F.col("batch_pos") == 0) | (F.col("batch_size") == 1), "batch_boundary")
        .when(flag(HB_EOS), "hb_eos").when(flag(EPOCH_EVENT), "epoch_event").otherwise("unknown")
    )
    return rows.where(F.col("latency") >= threshold).groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def theil_sen(pairs: DataFrame) -> DataFrame:
    """The upper median of all pairwise slopes (i, x, y); for calibration sets of some hundred rows."""
    a, b = pairs.select(F.col("i").alias("i1"), F.col("x").alias("x1"), F.col("y").alias("y1")), pairs.select(F.col("i").alias("i2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    slopes = a.join(b, F.col("i1") < F.col("i2")).where("x2 > x1").select(((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("slope"))
    return slopes.agg(F.sort_array(F.collect_list("slope")).alias("s")).select(F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("slope"), F.size("s").alias("n"))


def gate(value: Column, least: float | None = None, most: float | None = None) -> Column:
    ok = F.lit(True)
    if least is not None:
        ok = ok & (value >= least)
    if most is not None:
        ok = ok & (value < most)
    return F.when(ok, "PASS").otherwise("FAIL")
