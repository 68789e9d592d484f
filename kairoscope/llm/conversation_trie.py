"""Prefix trie of conversations, each shard a sequence of balanced parentheses.

Each conversation is a path of turns; a node stands for the conversations that begin
with the same turns. Different paths are range partitioned and sorted, so every
partition holds a run of the trie in depth-first order. It is cut into shards of a
bounded number of nodes. A shard writes a bit for every opened and closed node; blocks of
the excess, with a tree of their minima, answer ``findclose`` for all nodes at once.
The matching parentheses delimit subtrees, and everything else is a difference of
cumulative arrays between them: members, savings, and leaves by the rank of ``()`` pairs.

Only the nodes on the first and the last path of a shard, its spines, can go on in
another shard. They are not finished there but written as paths that carry what their
closed subtrees add up to. These paths, at most two a shard, are sorted and sharded once
more, equal nodes merging into one, until a single shard is left. Nodes below a spine
find their parent's name by its digest.

A turn enters as a digest of role and text and its length, so texts are read where they
lie and never shuffled. Equal conversations meet in a pre-aggregated grouping, in blocks
of their numbers; the digest of a node's members runs through the blocks in order. A tree
that holds most conversations is spread by its deeper turns. Only a single conversation,
and the path to it, stays together; a task holds one shard.

Turns are ordered by ``turn``, null first, ties by digest of role and text; null roles and
texts count as empty. Repeated rows are turns of their own. Rows without a conversation id
belong to no conversation and are left out. Very long texts only cost their digest, very
long conversations a path of 16 bytes a turn. Other columns are not used. An empty table
has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Bytes of a turn's digest in a path.
STEP = 16
#: Excess values in a block of the range min-max tree.
BLOCK = 64
#: A shard ends at so many nodes, if it has enough paths for the next round to be smaller.
SHARD_NODES = 1 << 18
SHARD_PATHS = 8
#: Nodes whose closing parentheses are searched together.
SEARCH = 1 << 14
#: Conversation numbers in a block of members.
MEMBERS = 1 << 16
NONE = (1 << 63) - 1
ROOT_KEY = bytes(STEP)
#: Names of spine nodes that are broadcast at most (some 30 bytes each); beyond it an ordinary join is used.
BROADCAST_ROWS = 1_000_000


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with its excess in blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        self.opens = np.flatnonzero(bits)
        blocks = -(-len(bits) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(bits)] = self.excess
        self.blocks = padded.reshape(blocks, BLOCK)
        #: Minima of blocks, of pairs of blocks, and so on.
        self.low = [self.blocks.min(axis=1)]
        while len(self.low[-1]) > 1:
            level = self.low[-1]
            if len(level) % 2:
                level = np.append(level, np.iinfo(np.int32).max).astype(np.int32)
                self.low[-1] = level
            self.low.append(level.reshape(-1, 2).min(axis=1))
        pairs = np.zeros(len(bits) + 1, np.int64)
        if len(bits) > 1:
            pairs[1:-1] = np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))
            pairs[-1] = pairs[-2]
        self.pairs = pairs

    def _first_at_most(self, block: np.ndarray, target: np.ndarray, after: np.ndarray) -> np.ndarray:
        """First place in a block behind ``after`` whose excess is at most the target; -1 if none."""
        place = block[:, None] * BLOCK + np.arange(BLOCK)
        hit = (self.blocks[block] <= target[:, None]) & (place > after[:, None])
        return np.where(hit.any(axis=1), block * BLOCK + hit.argmax(axis=1), -1)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at the given places are closed."""
        out = np.empty(len(opens), np.int64)
        for low in range(0, len(opens), SEARCH):
            out[low : low + SEARCH] = self._find_close(opens[low : low + SEARCH])
        return out

    def _find_close(self, opens: np.ndarray) -> np.ndarray:
        target = self.excess[opens] - 1
        found = self._first_at_most(opens // BLOCK, target, opens)
        far = np.flatnonzero(found < 0)
        node, goal = opens[far] // BLOCK, target[far]
        landed = np.full(len(far), -1, np.int64)
        height = np.zeros(len(far), np.int64)
        waiting = np.arange(len(far))
        for level, minima in enumerate(self.low):  # up, until the minimum of a right sibling is low enough
            here = node[waiting]
            right = np.minimum(here + 1, len(minima) - 1)
            hit = (here % 2 == 0) & (here + 1 < len(minima)) & (minima[right] <= goal[waiting])
            landed[waiting[hit]], height[waiting[hit]] = here[hit] + 1, level
            waiting = waiting[~hit]
            node[waiting] //= 2
        for level in range(len(self.low) - 1, 0, -1):  # and down again, to the left where that is low enough
            going = np.flatnonzero(height == level)
            left = landed[going] * 2
            landed[going] = np.where(self.low[level - 1][left] <= goal[going], left, left + 1)
            height[going] = level - 1
        found[far] = self._first_at_most(landed, goal, np.full(len(far), -1))
        return found

    def subtree_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node, in the order of opening: where it closes and how many nodes it spans."""
        closes = self.find_close(self.opens)
        return closes, (closes - self.opens + 1) // 2

    def leaf_pairs(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """``()`` pairs within each span, by rank."""
        return self.pairs[closes] - self.pairs[opens]


class Shard:
    """The nodes of consecutive paths, in the order of opening. ``named``: all have their digests."""

    def __init__(self, named: bool):
        self.named = named
        self.bits = bytearray(b"\x01")
        self.depth, self.parent, self.chars, self.keys = [0], [-1], [0], [ROOT_KEY]
        #: What a node has besides its subtrees in this shard: members, the smallest, children, leaves, savings.
        self.own = [[0, NONE, 0, 0, 0]]
        self.ends: dict[int, bytes] = {}
        self.first, self.open = [0], [0]  # nodes of the first and the last path
        self.first_path, self.path = b"", b""
        self.first_lengths, self.lengths = [], []
        self.paths = 0

    def add(self, path: bytes, lengths: list[int], own: list[tuple]) -> None:
        """Take in a path, at or behind the last one, and what some of its nodes have."""
        shared, limit = 0, min(len(path), len(self.path)) // STEP
        if path[: limit * STEP] == self.path[: limit * STEP]:
            shared = limit
        else:
            while path[shared * STEP : shared * STEP + STEP] == self.path[shared * STEP : shared * STEP + STEP]:
                shared += 1
        self.bits += bytes(len(self.open) - 1 - shared)
        del self.open[shared + 1 :]
        for d in range(shared, len(path) // STEP):
            above = self.open[-1]
            self.bits.append(1)
            self.depth.append(d + 1)
            self.parent.append(above)
            self.chars.append(lengths[d])
            self.own.append([0, NONE, 0, 0, 0])
            if self.named:
                self.keys.append(child_key(self.keys[above], path[d * STEP : d * STEP + STEP]))
            self.open.append(len(self.depth) - 1)
        for depth, members, smallest, children, leaves, saved, ends in own:
            node = self.open[depth]
            mine = self.own[node]
            mine[0] += members
            mine[1] = min(mine[1], smallest)
            mine[2] += children
            mine[3] += leaves
            mine[4] += saved
            if ends is not None:
                self.ends[node] = ends
        self.path, self.lengths = path, lengths
        if not self.paths:
            self.first, self.first_path, self.first_lengths = list(self.open), path, lengths
        self.paths += 1


def child_key(parent: bytes, step: bytes) -> bytes:
    return hashlib.blake2b(parent + step, digest_size=STEP).digest()


_PARTS = ("depth", "members", "smallest", "children", "leaves", "saved", "ends")
_COUNTS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_OWN = pa.list_(pa.struct([*[(name, pa.int64()) for name in _PARTS[:-1]], ("ends", pa.binary())]))
_NODE = [("key", pa.binary()), ("parent_key", pa.binary()), *[(name, pa.int64()) for name in _COUNTS], ("ends", pa.binary())]
_SPINE = [("path", pa.binary()), ("lengths", pa.list_(pa.int64())), ("own", _OWN)]
_NAMES = [name for name, _ in (*_NODE, *_SPINE)]
_SCHEMA = (
    "key binary, parent_key binary, " + ", ".join(f"{name} long" for name in _COUNTS) + ", ends binary, path binary, lengths array<long>, "
    "own array<struct<" + ", ".join(f"{name}: long" for name in _PARTS[:-1]) + ", ends: binary>>"
)
_NO_ENDS = hashlib.sha256(b"").digest()


def close_shard(shard: Shard, whole: bool) -> Iterator[pa.RecordBatch]:
    """Finished nodes of a shard and, unless it is the whole trie, its spines as paths."""
    tree = Parentheses(np.frombuffer(bytes(shard.bits) + bytes(len(shard.open)), np.uint8))
    closes, sizes = tree.subtree_sizes()
    count = len(sizes)
    own = np.array(shard.own, np.int64)
    parent, depth = np.array(shard.parent, np.int64), np.array(shard.depth, np.int64)

    def total(values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, as differences of a cumulative array."""
        upto = np.concatenate([[0], np.cumsum(values)])
        return upto[np.arange(count) + sizes] - upto[:count]

    members = total(own[:, 0])
    children = own[:, 2] + np.bincount(parent[1:], minlength=count)
    # A pair is no leaf if the node has children that were closed in another shard.
    leaves = tree.leaf_pairs(tree.opens, closes) + total(own[:, 3] - ((sizes == 1) & (own[:, 2] > 0)))
    smallest = own[:, 1].copy()
    deepest = np.argsort(-depth, kind="stable")
    for nodes in np.split(deepest, np.flatnonzero(np.diff(depth[deepest])) + 1):
        if depth[nodes[0]]:
            np.minimum.at(smallest, parent[nodes], smallest[nodes])
    spine = np.zeros(count, bool)
    if not whole:
        spine[shard.first] = spine[shard.open] = True
    # Spine nodes count their savings when all their members are known.
    weight = np.where(spine, 0, (members - 1) * np.array(shard.chars, np.int64))
    saved = total(own[:, 4] + weight)

    key: dict[int, bytes] = dict(enumerate(shard.keys)) if shard.named else {0: ROOT_KEY}
    if not shard.named and not whole:
        for path, nodes in ((shard.first_path, shard.first), (shard.path, shard.open)):
            for d, (above, node) in enumerate(zip(nodes, nodes[1:])):
                key[node] = child_key(key[above], path[d * STEP : d * STEP + STEP])

    done = np.flatnonzero(~spine)
    above = parent[done]
    asks = (above >= 0) & spine[above]
    columns = [
        [key[n] for n in done.tolist()] if shard.named else [None] * len(done),
        [key[p] if a else None for a, p in zip(asks.tolist(), above.tolist(), strict=True)],
        smallest[done], depth[done],
        [None if a or p < 0 else int(smallest[p]) for a, p in zip(asks.tolist(), above.tolist(), strict=True)],
        members[done], children[done], leaves[done], saved[done],
        [shard.ends.get(n, _NO_ENDS) for n in done.tolist()],
    ]
    for low in range(0, len(done), SEARCH):
        part = [pa.array(c[low : low + SEARCH], kind) for c, (_, kind) in zip(columns, _NODE, strict=True)]
        yield pa.RecordBatch.from_arrays([*part, *[pa.nulls(len(part[0]), kind) for _, kind in _SPINE]], _NAMES)
    if whole:
        return

    # What each spine node has of its own and from the subtrees that were closed here.
    below = done[asks]
    for place, values in ((0, members), (2, np.ones(count, np.int64)), (3, leaves), (4, saved)):
        np.add.at(own[:, place], parent[below], values[below])
    np.minimum.at(own[:, 1], parent[below], smallest[below])
    rows = []
    told: set[int] = set()
    for path, lengths, nodes in ((shard.first_path, shard.first_lengths, shard.first), (shard.path, shard.lengths, shard.open)):
        new = [n for n in nodes if n not in told]
        told.update(new)
        if new:
            parts = [dict(zip(_PARTS, (int(depth[n]), *own[n].tolist(), shard.ends.get(n)), strict=True)) for n in new]
            rows.append((path, lengths, parts))
    spines = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _SPINE, strict=True)]
    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), kind) for _, kind in _NODE], *spines], _NAMES)


Path = tuple[bytes, list[int], list[tuple]]


def _from_members(batches: Iterator[pa.RecordBatch]) -> Iterator[Path]:
    """Different conversations with all their members, from sorted (path, lengths, block, members)."""
    path, lengths, count, smallest, digest = None, [], 0, 0, hashlib.sha256()
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != path:
                if path is not None:
                    yield path, lengths, [(len(path) // STEP, count, smallest, 0, 0, 0, digest.digest())]
                path, lengths, count, smallest, digest = row["path"], row["lengths"], 0, row["members"][0], hashlib.sha256()
            digest.update((b"," if count else b"") + ",".join(map(str, row["members"])).encode())
            count += len(row["members"])
    if path is not None:
        yield path, lengths, [(len(path) // STEP, count, smallest, 0, 0, 0, digest.digest())]


def _from_spines(batches: Iterator[pa.RecordBatch]) -> Iterator[Path]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["path"], row["lengths"], [tuple(part[name] for name in _PARTS) for part in row["own"]]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation's turns behind the first ones of the conversation at its hundred:
    ``conv_id``, ``path`` (a digest of 16 bytes for each turn) and ``lengths`` in code points.

    Remainders have the sign of the number, as in SQL.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text).cast("binary")
    turn = F.struct("turn", F.substring(F.sha2(said, 256), 1, 2 * STEP).alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).filter("conv_id is not null")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = grouped.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    heads = grouped.filter("conv_id = base").select("base", F.slice("turns", 1, 5).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = F.slice("turns", shared + 1, F.greatest(F.size("turns") - shared, F.lit(0)))
    # At most a hundred conversations share a head.
    joined = grouped.join(heads, "base", "left").withColumn("turns", F.concat(F.coalesce(F.slice("head", 1, shared), F.slice("turns", 1, 0)), own))
    return joined.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["chars"]).alias("lengths"),
    )


def build(paths: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes of the trie of ``paths`` (``conv_id``, ``path``, ``lengths``; ids differ).

    Per node: ``conv_id``, the smallest member; ``depth``; ``parent_conv_id``; ``n_convs``;
    ``n_children``; ``n_leaves``; ``saved_tokens`` and ``ends_sha256``, see the queries' contract.
    """
    block = F.shiftright("conv_id", MEMBERS.bit_length() - 1).alias("block")
    grouped = paths.groupBy("path", block).agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_list("conv_id")).alias("members"))
    current, named, rounds = stage(grouped.select("path", "lengths", "block", "members"), "members"), False, []
    while True:
        size = current.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("path").cast("long")).alias("bytes")).first()
        # Enough paths for each task that the next round has fewer; the last few make one shard.
        tasks = min(-(-(size["bytes"] or 0) // (STEP * shard_nodes)), size["rows"] // (2 * SHARD_PATHS))
        whole = tasks <= 1
        order = ["path"] if named else ["path", "block"]
        ordered = current.repartitionByRange(max(1, tasks), "path").sortWithinPartitions(*order)

        def run(batches: Iterator[pa.RecordBatch], named: bool = named, whole: bool = whole) -> Iterator[pa.RecordBatch]:
            shard = Shard(named)
            for path, lengths, own in (_from_spines if named else _from_members)(batches):
                if not whole and len(shard.depth) >= shard_nodes and shard.paths >= SHARD_PATHS:
                    yield from close_shard(shard, False)
                    shard = Shard(named)
                shard.add(path, lengths, own)
            if shard.paths:
                yield from close_shard(shard, whole)

        made = stage(ordered.mapInArrow(run, _SCHEMA), "trie")
        rounds.append(made.filter("path is null").drop("path", "lengths", "own"))
        if whole:
            break
        current, named = made.filter("path is not null").select("path", "lengths", "own"), True

    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.unionByName(more)
    if len(rounds) > 1:
        names = None
        for more in rounds[1:]:
            part = more.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_name"))
            names = part if names is None else names.unionByName(part)
        names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
        asking = nodes.filter("parent_key is not null").join(names, "parent_key", "left")
        asking = asking.withColumn("parent_conv_id", F.col("_name")).drop("_name")
        nodes = nodes.filter("parent_key is null").unionByName(asking)
    return nodes.select(*_COUNTS, F.lower(F.hex("ends")).alias("ends_sha256"))
