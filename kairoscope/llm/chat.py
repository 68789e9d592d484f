"""Chat formatting as a prefix tree.

Conversations that share their first turns share tree nodes. A node is a turn after
a given history, so its id is a digest chained over the turns. Different conversations
are range partitioned and sorted by their path of node ids; in this order each one
adds just the nodes behind the turns it shares with the one before, and these come
depth first. Every partition is a shard, a stream of its own: within it every node's
tokens are emitted once, with the position of its first token in its conversation (the
tokens of its ancestors) and the intervals of the stream it may attend to, its
ancestors' and its own, joined where they touch. A conversation is read back from its
shard by following its nodes.

The template of a turn is ``<s>[INST]role[/INST]text</s>``. Control strings inside roles
and texts get a backslash after their first character, and those that have backslashes
there get one more, which is undone by taking one away. The text of assistant turns,
without marks, is under the loss mask.

Equal conversations are collapsed by a pre-aggregated grouping before sorting, and a
tree that holds most conversations is spread over shards by its deeper turns; a shard
that begins inside a tree repeats the open turns of its first conversation, since no
token can attend across shards. A task keeps one path and its intervals, so work and
memory are linear in a conversation's length. Only a single conversation stays together.

Turns are sorted by ``turn``, ties by role and text. Null roles and texts count as
empty; rows with a null conversation id form one conversation. Repeated rows are turns
of their own. An empty table gives empty results. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .bpe import RankCodec

BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"
#: About how much a task gathers before it sends rows on.
BATCH_BYTES = 4 << 20
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2] + m[3], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            raise ValueError("text outside of turns")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return turns


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the path of node ids, 16 bytes a turn, and the last of them."""
    for batch in batches:
        paths = []
        for turns in batch.column(1).to_pylist():
            path = []
            for turn in turns:
                head = f"{len(turn['role'])} {turn['role']}".encode()
                before = path[-1] if path else b""
                path.append(hashlib.blake2b(before + head + turn["text"].encode(), digest_size=16).digest())
            paths.append(b"".join(path))
        columns = [*batch.columns, pa.array(paths, pa.binary()), pa.array([p[-16:] for p in paths], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "path", "leaf"])


@dataclass
class Tree:
    """``nodes``: one row per emitted node; ``members``: where each conversation's nodes are."""

    nodes: DataFrame
    members: DataFrame


_NODE = (
    "shard long, node binary, parent binary, root binary, depth long, leaf boolean, ids binary, loss_from long, loss_to long, "
    "start long, end long, position long, attends array<struct<start: long, end: long>>"
)


def build(conversations: DataFrame, vocabulary: str) -> Tree:
    """Nodes: ``shard``, ``node``, ``parent``, ``root``, ``depth``, ``leaf`` (a conversation ends here),
    ``ids`` (packed little-endian unsigned 32-bit), ``loss_from`` and ``loss_to`` (tokens of the
    node under the mask), ``start`` and ``end`` in the shard's stream, ``position`` of the first
    token and ``attends``, the joined intervals of its ancestors and itself in the stream.
    Members: ``conv_id``, ``shard``, ``index``, ``node``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    said = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    pair = "array<struct<role: string, text: string>>"
    paths = stage(said.mapInArrow(_paths, f"conv_id long, turns {pair}, path binary, leaf binary"), "paths")
    distinct = paths.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.repartitionByRange(spread, "path").sortWithinPartitions("path").select("path", "turns")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard, at = RankCodec.of(vocabulary), TaskContext.get().partitionId(), 0
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.bool_(), pa.binary(), *[pa.int64()] * 5, spans]
        names = "shard node parent root depth leaf ids loss_from loss_to start end position attends".split()
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        stack: list[tuple[bytes, int, tuple]] = []  # the open path: node, position after it, intervals
        rows, size = [], 0
        for batch in batches:
            for path, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes = [path[i : i + 16] for i in range(0, len(path), 16)]
                shared = 0
                while shared < min(len(stack), len(nodes)) and stack[shared][0] == nodes[shared]:
                    shared += 1
                del stack[shared:]
                for depth in range(shared, len(nodes)):
                    role, text = turns[depth]["role"], turns[depth]["text"]
                    parts = [codec.encode(x) for x in (BEGIN + ROLE + escape(role) + TEXT, escape(text), END)]
                    head, body, tail = map(len, parts)
                    end = at + head + body + tail
                    before, seen = (stack[-1][1], stack[-1][2]) if stack else (0, ())
                    if seen and seen[-1][1] == at:  # right behind its parent: one interval with it
                        seen = (*seen[:-1], (seen[-1][0], end))
                    else:
                        seen = (*seen, (at, end))
                    ids = b"".join(x.astype("<u4").tobytes() for x in parts)
                    rows.append(
                        (shard, nodes[depth], nodes[depth - 1] if depth else None, nodes[0], depth + 1, depth == len(nodes) - 1, ids,
                         head, head + body * (role == LOSS_ROLE), at, end, before, [{"start": a, "end": b} for a, b in seen])
                    )
                    stack.append((nodes[depth], before + end - at, seen))
                    at, size = end, size + len(ids) + 16 * len(seen) + 100
                    if size > BATCH_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
        if rows:
            yield pack(rows)

    nodes = stage(ordered.mapInArrow(emit, _NODE), "emitted")
    placed = nodes.filter("leaf").select(F.col("node").alias("leaf"), "shard")
    members = paths.select("conv_id", "path", "leaf").join(placed, "leaf")
    step = F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("path") / 16).cast("int") - 1), lambda n: n)).alias("index", "n")
    members = members.select("conv_id", "shard", "path", step)
    members = members.select("conv_id", "shard", F.col("index").cast("long").alias("index"), F.expr("substring(path, 16 * n + 1, 16)").alias("node"))
    return Tree(nodes, members)


def read_back(tree: Tree, vocabulary: str) -> DataFrame:
    """Every conversation from the emitted tokens: ``conv_id``, ``formatted``, ``turns`` (role,
    text) and ``loss_text``, the unescaped text under the mask in order."""
    parts = tree.members.join(tree.nodes.select("shard", "node", "ids", "loss_from", "loss_to"), ["shard", "node"])
    part = F.struct("index", "ids", "loss_from", "loss_to")
    grouped = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = RankCodec.of(vocabulary).vocabulary.bytes_of
        text_of = lambda ids: b"".join(map(tokens.__getitem__, memoryview(ids).cast("I").tolist())).decode()
        pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        names, types = ["conv_id", "formatted", "turns", "loss_text"], [pa.int64(), pa.string(), pair, pa.string()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
        )
        rows, size = [], 0
        for batch in batches:
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                formatted = text_of(b"".join(p["ids"] for p in parts))
                turns = [{"role": r, "text": t} for r, t in parse(formatted)]
                loss = "".join(unescape(text_of(p["ids"][4 * p["loss_from"] : 4 * p["loss_to"]])) for p in parts)
                rows.append((conv, formatted, turns, loss))
                size += len(formatted)
                if size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return grouped.mapInArrow(run, "conv_id long, formatted string, turns array<struct<role string, text string>>, loss_text string")
