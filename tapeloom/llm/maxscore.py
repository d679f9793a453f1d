"""Exact top-k by inner product with MaxScore over shards of integer vectors.

A vector is a document whose terms are its dimensions; a posting's impact is the component. A dimension has two posting
lists, of rows with a positive and with a negative component; for a query the list whose sign is that of the query's
component can add to a score (at most the query's component times the list's largest impact, the dimension's bound), the
other can only take away.

For a query a shard's rows are traversed in blocks of ROWS by rising id, with the bounds of each block. Dimensions are
ordered by bound; those of smallest bounds that together can't lift a row above the k-th score so far are non-essential. A
row that is in no essential list can't compete and is not looked at; the others get their essential impacts and are then
probed in the non-essential dimensions, largest bound first, while what they have plus the bounds that are left competes. The
k-th score rises from block to block, and with it the non-essential part; a block whose bounds all together don't reach it
is skipped. Shards give k candidates per query, which are merged by score and id.

Candidates never move: a task cuts the rows it reads into shards of SHARD and streams the queries, a table in the shared
folder, past each of them. Embeddings are dense, so the essential lists hold nearly all rows and it is the probing that ends early.

Defined results: vectors that are null or hold a null or non-finite component take no part, as queries or candidates;
components whose product with the scale passes 64 bits saturate there; shorter vectors count as padded with zeros; ties go to the
smaller id; a candidate with the query's own id is never returned, rows repeated under another id are candidates each; a row
repeated under an id asks once for each distinct vector; null ids take no part; an empty table gives no rows; other columns, also
those named like results, play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import Scratch, filesystem

#: Rows of a shard and of a block of it, queries in hand at once, dimensions probed at once.
SHARD, ROWS, QUERIES, STEP = 8192, 2048, 1024, 8


def quantised(column: str | Column = "embedding", scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    c = F.col(column) if isinstance(column, str) else column
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(c.isNotNull() & ~bad, F.transform(c, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray, wide: int = 0) -> np.ndarray:
    lengths = column.combine_chunks().value_lengths().to_numpy()
    flat = column.combine_chunks().flatten().to_numpy()
    out = np.zeros((len(lengths), max(wide, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """float64 (fast products) while every sum is exact in it, else int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if most < 2**52 else np.int64


class Shard:
    """Rows by rising id in blocks, each with its largest impact of either sign in every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.blocks = []
        for at in range(0, len(ids), ROWS):
            own = self.vectors[at : at + ROWS]
            self.blocks.append((at, own, np.ascontiguousarray(own.T), np.maximum(own.max(0), 0), np.minimum(own.min(0), 0)))


def essential(bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Dimensions by falling bound, and how many of them are essential: the others' bounds together don't pass the threshold."""
    order = np.argsort(-bounds, kind="stable")
    rest = np.cumsum(bounds[order][::-1])[::-1]  # what each dimension and all after it can add
    return order, int(np.searchsorted(-rest, -threshold, side="left"))


def best(own: int, q: np.ndarray, shard: Shard, k: int, tally: Counter | None = None) -> list[tuple[int, int]]:
    """(score, id) of one query's k best in the shard, best first. tally counts postings: all, essential, probed, skipped."""
    scores, ids, threshold = np.zeros(0, q.dtype), np.zeros(0, np.int64), -np.inf
    for at, rows, postings, high, low in shard.blocks:
        bounds = np.maximum(q * high, q * low)
        order, n = essential(bounds, threshold)
        if tally is not None:
            tally["all"] += rows.size
            tally["blocks"] += 1
        if not n:
            if tally is not None:
                tally["skipped"] += rows.size
            continue  # nothing here passes the threshold; equal scores go to smaller ids, which were before
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        lead = order[:n]
        score = q[lead] @ postings[lead]
        # A row in no essential list has no component of the query's sign there, so that its score can't pass the others' bounds.
        alive = np.flatnonzero((score + rest[n] > threshold) & (shard.ids[at : at + len(rows)] != own))
        score = score[alive]
        if tally is not None:
            tally["essential"] += n * len(rows)
        for begin in range(n, len(order), STEP):
            if not len(alive):
                break
            some = order[begin : begin + STEP]
            score = score + rows[np.ix_(alive, some)] @ q[some]
            if tally is not None:
                tally["probed"] += len(alive) * len(some)
            stay = score + rest[begin + len(some)] > threshold
            alive, score = alive[stay], score[stay]
        scores, ids = np.append(scores, score), np.append(ids, shard.ids[at + alive])
        if len(scores) > k:
            first = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[first], ids[first]
        if len(scores) == k:
            threshold = scores.min()
    first = np.lexsort((ids, -scores))
    return [(int(s), int(i)) for s, i in zip(scores[first], ids[first], strict=True)]


def top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, tally: Counter | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best in one shard."""
    kind = exact_type(queries, vectors)
    shard = Shard(ids, vectors.astype(kind))
    return [(int(own), i, s) for own, q in zip(query_ids, queries.astype(kind), strict=True) for s, i in best(int(own), q, shard, k, tally)]


def search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, id and score of each query's k best among all rows of df."""
    scratch = Scratch(df.sparkSession, "maxscore")
    rows = df.select(F.col(key).cast("bigint").alias("id"), quantised(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v IS NOT NULL AND id IS NOT NULL")
    rows = scratch.write(rows, "quantised")
    scratch.write(rows.where("asks").select("id", "v").distinct(), "queries")
    asked = scratch.path("queries")
    names = ("query_id", "id", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = filesystem(asked)
            table = pa.Table.from_batches(some)
            own, ids = _matrix(table.column("v")), table.column("id").to_numpy()
            for b in pads.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=QUERIES):
                one = pa.Table.from_batches([b])
                if one.num_rows:
                    wide = max(1, own.shape[1], _matrix(one.column("v")).shape[1])
                    vectors = np.pad(own, ((0, 0), (0, wide - own.shape[1])))
                    rows = top(one.column("id").to_numpy(), _matrix(one.column("v"), wide), ids, vectors, k)
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=names)

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                piece = batch.slice(at, SHARD)
                if held and n + piece.num_rows > SHARD:
                    yield from found(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield from found(held)

    out = rows.select("id", "v").mapInArrow(run, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
