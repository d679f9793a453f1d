"""Chat formatting as a prefix tree: conversations that share their first turns share those turns' tokens.

A node is a turn under the turns before it. Conversations are sorted by the digests of their turns, which is the tree's
depth-first order; each conversation then emits the nodes beyond what it shares with the one before it, so that every
node is emitted once. Offsets run through the whole output. A token is a code point of the formatted text.

Output rows (one table, in packs; within a pack by seq and depth):
  node     a turn's formatted text, its start in the stream, its position (the position id of its first token), the
           ancestors' intervals of the stream that its tokens attend to besides the node's own earlier tokens, and the
           interval of its text under the loss mask (assistant texts);
  carried  at a pack's begin, the nodes of earlier packs that the pack's first conversation goes on from, with their
           own starts: references, not tokens, that make a pack readable alone;
  end      a conversation ends at the node of this depth.

Template: <|im_start|>role NEWLINE text<|im_end|> NEWLINE. Inside role and text, < followed by backslashes and | gets one backslash
more; in roles, backslashes and new lines are escaped too. Both are undone by reading.

A conversation moves as 20 bytes for each turn until the order is known; texts stay a row for each turn and meet their place by
conversation, so no task gathers a conversation's text.

Defined results: null roles and texts are empty; a null conversation id is a conversation; turns sort by turn (null
first), role, text; equal conversations share all nodes and end once each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import Scratch, shuffle_partitions

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def hide(text: str) -> str:
    return _HIDE.sub(r"<\\\1|", text)


def show(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def hide_role(role: str) -> str:
    return hide(role.replace("\\", "\\\\").replace("\n", "\\n"))


def show_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], show(role))


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text and the interval of its text inside."""
    head, body = f"{OPEN}{hide_role(role)}\n", hide(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = formatted[len(OPEN) :].partition("\n")
    return show_role(role), show(rest[: -len(CLOSE)])


def _turns(df: DataFrame) -> DataFrame:
    """conv_id, idx (from 1), formatted text, mask, digest and length of each turn."""
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(segment(r, t), r == "assistant") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("conv_id"),
                    b.column("idx"),
                    pa.array([s for (s, _, _), _ in found], pa.string()),
                    pa.array([a if on else 0 for (_, a, _), on in found], pa.int32()),
                    pa.array([z if on else 0 for (_, _, z), on in found], pa.int32()),
                    pa.array([hashlib.sha256(s.encode()).digest()[:16] for (s, _, _), _ in found], pa.binary()),
                    pa.array([len(s) for (s, _, _), _ in found], pa.int32()),
                ],
                names=["conv_id", "idx", "text", "loss_from", "loss_to", "digest", "length"],
            )

    return rows.mapInArrow(run, "conv_id bigint, idx int, text string, loss_from int, loss_to int, digest binary, length int")


PATHS = "pack int, seq bigint, conv_id bigint, path array<binary>, lengths array<int>, shared int, starts array<bigint>, emitted bigint"


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers sorted paths and tells what each shares with the one before it; starts count from the pack's begin, as if its first path shared nothing."""
    from pyspark import TaskContext

    pack, seq, before, starts, at = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        out = []
        for conv, path, lengths in zip(*(b.column(c).to_pylist() for c in ("conv_id", "path", "lengths")), strict=True):
            shared = 0
            for x, y in zip(before, path, strict=False):
                if x != y:
                    break
                shared += 1
            starts, begin = starts[:shared], at
            for n in lengths[shared:]:
                starts.append(at)
                at += n
            out.append((pack, seq, conv, path, lengths, shared, starts, at - begin))
            before, seq = path, seq + 1
        cols = list(zip(*out, strict=True)) or [[]] * 8
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["pack", "seq", "conv_id", "path", "lengths", "shared", "starts", "emitted"])


def _boundaries(paths: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """For each pack: its base offset, how many turns its first path shares with the pack before, and their starts.

    The driver reads two paths and a sum for each pack."""
    ends = paths.groupBy("pack").agg(F.max("seq").alias("seq"), F.sum("emitted").alias("emitted"))
    last = {r.pack: r for r in paths.join(ends.select("pack", "seq"), ["pack", "seq"]).select("pack", "path", "starts").collect()}
    first = {r.pack: r for r in paths.where("seq = 0").select("pack", "path", "lengths").collect()}
    out, base, before, carried = {}, 0, [], []
    for pack, total in sorted((r.pack, r.emitted) for r in ends.collect()):
        path = first[pack].path
        shared = next((i for i, (x, y) in enumerate(zip(before, path, strict=False)) if x != y), min(len(before), len(path)))
        out[pack] = (base, shared, carried[:shared])
        cut = sum(first[pack].lengths[:shared])
        starts = [carried[k] if s < cut else base + s - cut for k, s in enumerate(last[pack].starts)]
        base, before, carried = base + total - cut, last[pack].path, starts
    return out


PACKED = (
    "pack int, seq bigint, depth int, kind string, conv_id bigint, text string, start bigint, position bigint, length int, loss_from int, loss_to int, attend array<struct<from:bigint,to:bigint>>"
)
_ARROW = pa.schema(
    [("pack", pa.int32()), ("seq", pa.int64()), ("depth", pa.int32()), ("kind", pa.string()), ("conv_id", pa.int64()), ("text", pa.string()), ("start", pa.int64()), ("position", pa.int64()), ("length", pa.int32()), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("attend", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]
)


def _emit(packs: dict[int, tuple[int, int, list[int]]]):
    """Rows (pack, seq, idx, ...) in depth-first order to output rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, at, carried, starts = None, 0, 0, []
        stack: list[tuple[int, int, int, list]] = []  # start, length, position, intervals attended to
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["pack"] != pack:
                    pack, stack = r["pack"], []
                    at, carried, starts = packs[pack]
                depth = r["idx"]
                if r["ends"]:
                    out.append((pack, r["seq"], depth, "end", r["conv_id"], None, None, None, None, None, None, None))
                    continue
                del stack[depth - 1 :]
                old = r["seq"] == 0 and depth <= carried
                start = starts[depth - 1] if old else at
                intervals, position = [], 0
                if stack:
                    s, n, p, above = stack[-1]
                    position = p + n
                    intervals = [*above[:-1], {"from": above[-1]["from"], "to": s + n}] if above and above[-1]["to"] == s else [*above, {"from": s, "to": s + n}]
                stack.append((start, r["length"], position, intervals))
                at += 0 if old else r["length"]
                out.append((pack, r["seq"], depth, "carried" if old else "node", None, r["text"], start, position, r["length"], r["loss_from"], r["loss_to"], intervals))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)

    return run


def pack(df: DataFrame, scratch: Scratch, packs: int | None = None) -> DataFrame:
    """Writes the packed tree of df (conv_id, turn, role, text) and returns its table."""
    spark = df.sparkSession
    turns = scratch.write(_turns(df), "turns")
    paths = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "length"))).alias("t"))
    paths = paths.select("conv_id", F.col("t.digest").alias("path"), F.col("t.length").alias("lengths"))
    n = packs or shuffle_partitions(spark)
    paths = scratch.write(paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_order, PATHS), "paths")
    bounds = _boundaries(paths)
    places = paths.select("pack", "seq", F.col("conv_id").alias("_conv"), "shared", F.size("path").alias("turns"))
    nodes = turns.join(places, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("idx") > F.col("shared"))).select("pack", "seq", "idx", F.lit(False).alias("ends"), "conv_id", "text", "length", "loss_from", "loss_to")
    ends = places.select("pack", "seq", F.col("turns").alias("idx"), F.lit(True).alias("ends"), F.col("_conv").alias("conv_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("length", "int"), ("loss_from", "int"), ("loss_to", "int"))))
    rows = nodes.unionAll(ends).repartition(n, "pack").sortWithinPartitions("pack", "seq", "idx", "ends")
    return scratch.write(rows.mapInArrow(_emit(bounds), PACKED), "packed")


def read(packed: DataFrame, partitions: int) -> DataFrame:
    """Conversations read back from a packed tree: conv_id, n_turns, digests of turns and loss text, character counts.

    A pack streams by with a stack of digest states, so that shared turns are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                depth = r["depth"]
                if r["kind"] == "end":
                    turns, loss, chars, total = stack[depth - 1]
                    out.append((r["conv_id"], depth, turns.hexdigest(), chars, loss.hexdigest(), total))
                    continue
                del stack[depth - 1 :]
                turns, loss, chars, total = stack[-1] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                role, text = parse(r["text"])
                turns = turns.copy()
                turns.update(f"{role}\n{text}\n".encode())
                masked = show(r["text"][r["loss_from"] : r["loss_to"]])
                if masked:
                    loss = loss.copy()
                    loss.update(masked.encode())
                stack.append((turns, loss, chars + len(masked), total + len(r["text"])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    rows = packed.repartition(partitions, "pack").sortWithinPartitions("pack", "seq", "depth", F.col("kind") == "end")
    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
