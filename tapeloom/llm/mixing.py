"""Mixing sources to target weights by capped water-filling.

Targets: sources share the budget by weight; a source may not pass its cap (its size times max_epochs); what capped
sources leave is shared anew by weight. With sources in order of cap over weight this has a closed form: a source is
capped if, at the water level that the sources before it leave, its share passes its cap. That table has one row for
each source.

Draws: a source takes as many whole repetitions of all its documents as its target holds, then the rest by a seeded
hash order of the documents. The last document of that order is taken in part, so that every source meets its target to
the word. The order's cut is found from sums for hash buckets (partial aggregation), and only the cut bucket's rows are
put in order, so that a source with a third of all rows is no task's burden. Buckets are as many as give each some
BUCKET_ROWS of all rows; a result doesn't depend on their number, since they cut the same order.

Defined results: a null text has size 0; very long texts are counted whole; a null source is a source of its own, last; null
keys are keys like any other; repeated rows stay rows of their own and reruns agree (rows that are equal in key, size and
source are interchangeable); an empty table gives no rows; all sizes 0 give targets 0; other columns, also those named like results, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import WORDS, Scratch, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
#: Buckets of a source's hash order are 2^BUCKET_BITS at least, 2^MOST_BITS at most, and in between as BUCKET_ROWS asks.
BUCKET_BITS, MOST_BITS, BUCKET_ROWS = 12, 22, 65_536


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size, target: sizes has source and size; weights repeat over the sources in code-point order, null last."""
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source, as all windows here
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.least(F.sum("source_size").over(everything) * F.lit(float(budget)), F.sum("cap").over(everything)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    # Levels rise while sources are full; the first that isn't sets the level of all after it.
    free = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    target = F.when(F.col("full") | free.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), free["level"] * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def bucket_bits(rows: int) -> int:
    """How many bits of the hash name a bucket, for a table of that many rows."""
    return min(MOST_BITS, max(BUCKET_BITS, (rows // BUCKET_ROWS).bit_length()))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, split: bool = True, bits: int | None = None, **shares) -> DataFrame:
    """key, source, size, source_size, target and taken (words the mix takes of each row).

    split: the cut document is taken in part; otherwise it is taken whole if that brings the source nearer to its target."""
    scratch = Scratch(docs.sparkSession, "mixing")
    small = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"))
    small = small.withColumn("at", F.xxhash64(F.lit(seed), "key", "size"))
    small = scratch.write(small, "sizes")
    per = scratch.write(targets(small, **shares), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    per = per.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint"))
    bits = bucket_bits(small.count()) if bits is None else bits  # of a written table: its files' footers tell
    bucket = F.shiftright("at", 64 - bits)
    sums = small.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    running = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("below", running - F.col("in_bucket")).withColumnRenamed("source", "_s")
    cut = per.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("below") + F.col("in_bucket") > F.col("rest")), "left")
    cut = cut.groupBy("source", "source_size", "target", "whole", "rest").agg(F.min(F.struct("bucket", "below")).alias("cut"))
    plan = scratch.write(cut.select("source", "source_size", "target", "whole", "rest", F.col("cut.bucket").alias("cut"), F.col("cut.below").alias("below")), "plan")
    rows = small.withColumn("bucket", bucket).join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at_cut = F.col("bucket") == F.col("cut")
    order = Window.partitionBy("source").orderBy("at", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(at_cut).withColumn("room", F.col("rest") - F.col("below") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room")))
    if not split:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    inside = inside.withColumn("part", part).drop("room")
    others = rows.where(~at_cut | F.col("cut").isNull()).withColumn("part", F.when(F.col("cut").isNull() & (F.col("rest") > 0) | (F.col("bucket") < F.col("cut")), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("bigint")
    return inside.unionByName(others).select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """docs with each row as often as the mix takes its document whole (documents without words, and null texts: never).

    Keys should be unique: rows that share key, source and size are taken as often as each other. Results are defined as above; the columns are those of docs."""
    taken = mix(docs, key, source, text, split=False, **options).where("size > 0")
    times = taken.groupBy(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col("size").alias("_size")).agg(F.max(F.expr("taken div size")).cast("int").alias("_times")).where("_times > 0")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    return docs.withColumn("_words", word_count(text)).join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
