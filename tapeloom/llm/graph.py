"""Connected components by alternating large-star and small-star steps, all as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Scratch, in_tasks

ROUNDS = 60


#: Parts over which a node's pairs may spread.
SALTS = 64


def _with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """pairs (u, v), so many rows about, plus m, the least of u and all its v. A hub's pairs are dealt by u and a salt of v
    throughout: its least is that of its parts' leasts, and goes back to those parts only."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = in_tasks(dealt.groupBy("u", "salt").agg(F.min("v").alias("m")), rows)
    least = in_tasks(parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts")), rows)  # SALTS at most
    least = least.select(F.col("u").alias("_u"), F.least("u", "m").alias("m"), F.explode("salts").alias("_salt"))
    return in_tasks(dealt.join(least, (F.col("u") == F.col("_u")) & (F.col("salt") == F.col("_salt"))), rows).drop("_u", "salt", "_salt")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return in_tasks(_with_least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down, rows)
    moved = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return in_tasks(moved.unionAll(linked.select("u", F.col("m").alias("v"))).distinct(), rows)


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """node and root (the least node of its component) for every node of edges (a, b), which are counted first: best a written
    table; isolated nodes have no row.

    Each round is written to the shared folder, which cuts lineage and lets the previous round go. A round has as many tasks as
    its pairs need: with a task for each shuffle partition, rounds of few pairs cost the start of tasks and little else."""
    now = scratch.write(in_tasks(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), edges.count()), f"{name}-0")
    state = None
    for k in range(1, ROUNDS + 1):
        rows = now.count() if state is None else state[0]
        now = scratch.write(_small_star(_large_star(now, rows), rows), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
