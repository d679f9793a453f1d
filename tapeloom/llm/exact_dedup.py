"""Exact dedup against a minimal perfect hash of the distinct digests seen before.

History and arrivals are reduced to one row per digest first (partial aggregation absorbs hot digests). The history's
digests are dealt to shards by their leading bytes; a shard's index is a minimal perfect hash whose slots hold the
full 32-byte digests, the winner's locator and the number of rows. Arrivals look their digest up and compare all its
bytes with the slot's: members join the slot's winner, the others form groups among themselves.

Defined results: a null text is the empty text; texts are equal when equal after white-space runs became one space;
the row with the smallest key stays, null keys last; rows repeated under one key are one document and share its
decision; an empty table gives an empty result; other columns are left alone, clashing names are replaced.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACES, Scratch, text_or_empty
from tapeloom.llm.mphf import Mphf

#: Digests per shard of the index, about.
SHARD_KEYS = 50_000
SLOT = np.dtype([("digest", "V32"), ("winner", "<i8"), ("known", "?"), ("rows", "<i8")])


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _slots(t: pa.Table) -> np.ndarray:
    out = np.zeros(t.num_rows, SLOT)
    out["digest"] = np.frombuffer(b"".join(t.column("digest").to_pylist()), "V32")
    winner = t.column("winner")
    out["winner"] = winner.fill_null(0).to_numpy()
    out["known"] = winner.is_valid().to_numpy()
    out["rows"] = t.column("rows").to_numpy()
    return out


def _lanes(slots: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(slots["digest"]).view("<u8").reshape(-1, 4).astype(np.uint64)


def classes(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each digest: winner (smallest key) and rows."""
    return df.groupBy("digest").agg(F.min(key).alias("winner"), F.count(F.lit(1)).alias("rows"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of the history's classes: a row for each shard with its hash and its slots."""

    def build(t: pa.Table) -> pa.Table:
        slots = _slots(t)
        hashed = Mphf.build(_lanes(slots))
        placed = np.empty_like(slots)
        placed[hashed.lookup(_lanes(slots))] = slots
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "hash": [hashed.dump()], "slots": [placed.tobytes()]})

    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, hash binary, slots binary")


def lookup(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Classes over history and arrivals together: digest, winner, rows, and whether the history had the digest."""

    def probe(one: pa.Table, two: pa.Table) -> pa.Table:
        new = _slots(one)
        old = np.concatenate([np.frombuffer(x, SLOT) for x in two.column("slots").to_pylist()] or [np.zeros(0, SLOT)]).copy()
        member = np.zeros(len(new), bool)
        if len(old) and len(new):
            at = Mphf.load(two.column("hash")[0].as_py()).lookup(_lanes(new))
            near = np.maximum(at, 0)
            member = (at >= 0) & (_lanes(old[near]) == _lanes(new)).all(1)
            to, own = near[member], new[member]
            old["rows"][to] += own["rows"]
            lower = own["known"] & (~old["known"][to] | (own["winner"] < old["winner"][to]))
            old["winner"][to[lower]], old["known"][to[lower]] = own["winner"][lower], True
        out = np.concatenate([old, new[~member]])
        return pa.table(
            {
                "digest": pa.array([x.tobytes() for x in out["digest"]], pa.binary()),
                "winner": pa.array(out["winner"], mask=~out["known"]),
                "rows": pa.array(out["rows"]),
                "historical": pa.array(np.arange(len(out)) < len(old)),
            }
        )

    return arrivals.withColumn("shard", _shard(shards)).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, "digest binary, winner bigint, rows bigint, historical boolean")


def groups(df: DataFrame, history: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows' digests (key as _key, digest) and the classes over all rows, both as tables in the shared folder.

    history says which rows count as seen before (null: no). The key is an integer column."""
    scratch = Scratch(df.sparkSession, "exact-dedup")
    small = scratch.write(df.select(digest(text).alias("digest"), F.coalesce(history, F.lit(False)).alias("_past"), F.col(key).alias("_key")), "digests")
    shards = max(1, -(-small.count() // SHARD_KEYS))
    index = scratch.write(build_index(classes(small.where("_past"), "_key"), shards), "index")
    return small, scratch.write(lookup(classes(small.where("NOT _past"), "_key"), index, shards), "classes")


def decisions(df: DataFrame, history: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of df: its key, digest, keep_id, group_size, kept and historical. No text moves."""
    small, found = groups(df, history, key, text)
    return small.join(found, "digest").select(
        F.col("_key").alias(key), "digest", F.col("winner").alias("keep_id"), F.col("rows").alias("group_size"), F.col("_key").eqNullSafe(F.col("winner")).alias("kept"), "historical"
    )


def dedup(df: DataFrame, history: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with df's columns."""
    found = groups(df, history, key, text)[1].select(F.col("digest").alias("_digest"), F.col("winner").alias("_winner"))
    return df.withColumn("_own", digest(text)).join(found, (F.col("_own") == F.col("_digest")) & F.col(key).eqNullSafe(F.col("_winner")), "left_semi").drop("_own")
