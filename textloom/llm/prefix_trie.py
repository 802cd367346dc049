"""Conversation prefix trie: which turns conversations begin with, and what sharing them saves.

Turns are numbered in order by ranges and prefix sums, so a conversation may span tasks; their
texts stay where they are read, and rows carry two 64-bit hashes of role and text. Conversations
are rebuilt on the head of another one, and each place gets a key of its prefix (an exclusive or of
hashes of turns and places, in blocks). Equal conversations become one sequence with a count.

Shards. A prefix under which at most SHARD_TURNS turns of different sequences lie is light. The
shallowest light prefix of a sequence is its shard; prefixes above are upper nodes. A task packs the
sequences of a shard into a double array: turns get dense ids in the shard, state s with turn t goes
to slot BASE[s] + t, where CHECK says s. Walks through it count members, and sums go up from child to
parent along CHECK. So no task holds more than one shard, however many conversations begin alike.

Upper nodes. Every node has the smallest member as its owner, and on the path of a sequence those
that it owns are the deepest. A shard's sums, and those of an upper node itself, are booked on its
owner's path at its depth; sums from the end of each path, added up over the members of an upper
node, are its subtree's: each unit below a node lies on one member's path, its owner's.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.positions import row_positions, running

from .shared_store import stored

#: Conversation c is rebuilt on the head of c - c % FAMILY, of crc32(c) % HEADS turns.
FAMILY = 5
HEADS = 9
#: Turns below a prefix up to which a task packs them into one double array.
SHARD_TURNS = 1 << 14
#: Free slots that are tried at once for the turns of a state.
TRIED = 1024

NODE = ["depth", "k1", "k2"]


class DoubleArray:
    """A trie over dense turn ids in two arrays; state 0 is its root."""

    def __init__(self) -> None:
        self.base, self.check = [0], [-2]
        self.taken = np.zeros(64, bool)
        self.taken[0] = True
        self.free = 1  # no slot below is free

    def _slot(self, turns: list[int]) -> int:
        """The least base, as far as TRIED slots at a time show, at which the slots of all these (ascending) turns are free."""
        while self.free < len(self.taken) and self.taken[self.free]:
            self.free += 1
        if len(turns) == 1:
            return self.free - turns[0]
        apart, at = np.array(turns) - turns[0], self.free
        while True:
            need = at + TRIED + int(apart[-1])
            if need > len(self.taken):
                self.taken = np.append(self.taken, np.zeros(max(need - len(self.taken), len(self.taken)), bool))
            starts = at + np.flatnonzero(~self.taken[at : at + TRIED])
            for some in apart[1:]:
                starts = starts[~self.taken[starts + some]]
                if not len(starts):
                    break
            if len(starts):
                return int(starts[0]) - turns[0]
            at += TRIED

    def add(self, state: int, turns: list[int]) -> list[int]:
        """New states after this one, one for each of these different turns, in ascending order of turns; once for each state."""
        base = self.base[state] = self._slot(turns)
        slots = [base + t for t in turns]
        grow = slots[-1] + 1 - len(self.base)
        if grow > 0:
            self.base += [0] * grow
            self.check += [-1] * grow
        if slots[-1] >= len(self.taken):
            self.taken = np.append(self.taken, np.zeros(max(len(self.taken), slots[-1] + 1 - len(self.taken)), bool))
        for slot in slots:
            self.check[slot] = state
            self.taken[slot] = True
        return slots

    def next(self, state: int, turn: int) -> int | None:
        """The state that a turn leads to."""
        slot = self.base[state] + turn
        return slot if 0 <= slot < len(self.check) and self.check[slot] == state else None


def pack(sequences: list[list[tuple[int, int]]]) -> tuple[DoubleArray, dict[tuple[int, int], int], list[int]]:
    """A double array of these different sequences of turns, the dense ids of turns, and its states, parents first."""
    ordered, trie, dense = sorted(sequences), DoubleArray(), {}
    states, waiting = [0], deque([(0, 0, len(ordered), 0)])
    while waiting:
        state, low, high, depth = waiting.popleft()
        if low < high and len(ordered[low]) == depth:  # it ends here
            low += 1
        children: list[tuple[int, int, int]] = []
        at = low
        while at < high:
            turn, begin = ordered[at][depth], at
            while at < high and ordered[at][depth] == turn:
                at += 1
            children.append((dense.setdefault(turn, len(dense)), begin, at))
        if children:
            children.sort()
            for slot, (_, begin, end) in zip(trie.add(state, [c[0] for c in children]), children, strict=True):
                states.append(slot)
                waiting.append((slot, begin, end, depth + 1))
    return trie, dense, states


def shard_nodes(depth: int, members: list[tuple[int, int, list[tuple[int, int, int]]]]) -> list[tuple]:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end) of a shard's nodes; its root first, whose parent is None.

    members: conv_id, count, turns (two hashes, bytes) of different sequences, the root's turn first.
    """
    paths = [[(a, b) for a, b, _ in turns[1:]] for _, _, turns in members]
    trie, dense, states = pack(paths)
    size = len(trie.check)
    owner, count, last, ends, deep, children = [None] * size, [0] * size, [0] * size, [None] * size, [depth] * size, [0] * size
    for (conv, n, turns), path in zip(members, paths, strict=True):
        state = 0
        for k, (_, _, own) in enumerate(turns):
            if k:
                state = trie.next(state, dense[path[k - 1]])
            count[state] += n
            last[state], deep[state] = own, depth + k
            owner[state] = conv if owner[state] is None else min(owner[state], conv)
        ends[state] = conv
    for state in states[1:]:
        children[trie.check[state]] += 1
    leaves = [int(c == 0) for c in children]
    saved = [(c - 1) * b for c, b in zip(count, last, strict=True)]
    for state in reversed(states[1:]):
        above = trie.check[state]
        leaves[above] += leaves[state]
        saved[above] += saved[state]
    return [(owner[s], deep[s], owner[trie.check[s]] if s else None, count[s], children[s], leaves[s], saved[s], ends[s]) for s in states]


_NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, end bigint, p1 bigint, p2 bigint"


def _tries(light: DataFrame) -> DataFrame:
    """Nodes of all shards; p1, p2 (the key of the prefix above) for their roots only."""
    dealt = light.repartition("e", "s1", "s2").sortWithinPartitions("e", "s1", "s2", "conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in _NODES.split(", ")], pa.int64()
        shard, above, members, out = None, None, [], []

        def flush() -> None:
            if members:
                root, *rest = shard_nodes(shard[0], members)
                out.append((*root, *above))
                out.extend((*node, None, None) for node in rest)
                members.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

        for batch in batches:
            for e, s1, s2, conv, n, h1, h2, size, p1, p2 in zip(*(batch.column(c).to_pylist() for c in ("e", "s1", "s2", "conv_id", "n", "h1", "h2", "n_bytes", "p1", "p2")), strict=True):
                if (e, s1, s2) != shard:
                    flush()
                    shard, above = (e, s1, s2), (p1, p2)
                if not members or members[-1][0] != conv:
                    members.append((conv, n, []))
                members[-1][2].append((h1, h2, size))
            if out:
                yield batch_of(out)
                out.clear()
        flush()
        yield batch_of(out)

    return dealt.mapInArrow(run, _NODES)


def _ends(ends: DataFrame) -> DataFrame:
    """The sequences: conv_id (smallest member), n, length, k1, k2 and the digest of the ids of all members.

    A digest runs over ids in order, so the ids of one sequence pass through one task; none are held.
    """
    dealt = ends.repartition("length", "k1", "k2").sortWithinPartitions("length", "k1", "k2", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv_id", "n", "length", "k1", "k2", "ends_sha256"], [pa.int64()] * 5 + [pa.string()]
        key, first, n, running_digest = None, None, 0, None
        for batch in batches:
            out = []
            for own, conv in zip(zip(*(batch.column(c).to_pylist() for c in ("length", "k1", "k2")), strict=True), batch.column("conv_id").to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        out.append((first, n, *key, running_digest.hexdigest()))
                    key, first, n, running_digest = own, conv, 0, hashlib.sha256()
                running_digest.update((b"," if n else b"") + str(conv).encode())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((first, n, *key, running_digest.hexdigest()), kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, "conv_id bigint, n bigint, length bigint, k1 bigint, k2 bigint, ends_sha256 string")


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes from another one."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth (from 1), h1, h2, n_bytes, length of the rebuilt conversations, and conv_id of those without a turn.

    Rows are taken by (turn, role, hash of the text), null turns first; null role and text count as
    "". Rows of a null conv_id belong to no conversation and go.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    turns = row_positions(raw, ["turn", "role", "h1", "h2"], ["conv_id"]).select("conv_id", "position", "h1", "h2", "n_bytes")
    turns = stored(conversations.sparkSession, turns)
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    plan = sizes.withColumn("head", head_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base")), "base", "left_outer").withColumn("taken", F.least("head", F.coalesce("of_base", F.lit(0))))
    plan = plan.select("conv_id", "base", "head", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))
    own = turns.filter(F.col("position") >= head_turns(F.col("conv_id"))).join(plan.select("conv_id", "head", "taken", "length"), "conv_id")
    own = own.select("conv_id", (F.col("position") - F.col("head") + F.col("taken") + 1).alias("depth"), "h1", "h2", "n_bytes", "length")
    heads = turns.filter((F.col("position") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(plan.filter("taken > 0"), "base").filter("position < taken").select("conv_id", (F.col("position") + 1).alias("depth"), "h1", "h2", "n_bytes", "length")
    return own.unionByName(heads), plan.filter("length = 0").select("conv_id")


def prefix_trie(conversations: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Repeated rows are turns of their own. A table without conversations gives no rows, not even a
    root; columns besides conv_id, turn, role and text aren't read. Turns are told apart by 128 bits.
    """
    spark = conversations.sparkSession
    most = SHARD_TURNS if shard_turns is None else shard_turns
    rows, turnless = rebuilt_turns(conversations)
    marked = rows.select("*", F.xxhash64("depth", "h1", "h2").alias("x1"), F.xxhash64(F.lit(2), "h2", "h1", "depth").alias("x2"))
    keyed = stored(spark, running(marked, "conv_id", F.col("depth"), {"k1": F.col("x1"), "k2": F.col("x2")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b)))
    none = F.lit(0).cast("bigint")
    ends = keyed.filter("depth = length").select("conv_id", "length", "k1", "k2").unionByName(turnless.select("conv_id", none.alias("length"), none.alias("k1"), none.alias("k2")))
    sequences = stored(spark, _ends(ends))
    rows = keyed.join(sequences.select("conv_id", "n"), "conv_id")
    rows = stored(spark, rows.select("conv_id", "depth", "h1", "h2", "n_bytes", "length", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "n"))
    below = rows.groupBy(*NODE).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("turns"))
    upper = below.filter(F.col("turns") > most).select(*NODE, F.lit(True).alias("upper"))
    told = rows.join(upper, NODE, "left_outer")
    told = stored(spark, told.withColumn("upper", F.col("upper").isNotNull()))

    # a sequence has at most ``most`` light rows, so its window is small
    light = told.filter("not upper").groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("root"))
    light = told.filter("not upper").join(light, "conv_id").select("conv_id", "depth", "h1", "h2", "n_bytes", "n", "p1", "p2", F.col("root.depth").alias("e"), F.col("root.k1").alias("s1"), F.col("root.k2").alias("s2"))
    packed = stored(spark, _tries(light))
    shards = packed.filter("p1 is not null")

    # the root is an upper node of every sequence
    top = sequences.select("conv_id", none.alias("depth"), none.alias("k1"), none.alias("k2"), none.alias("n_bytes"), "length", none.alias("p1"), none.alias("p2"), "n")
    paths = told.filter("upper").select(*top.columns).unionByName(top)
    members = paths.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.sum("n").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min(F.when(F.col("depth") == F.col("length"), F.col("conv_id"))).alias("end"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    members = stored(spark, members)
    above = (F.col("depth") - 1).alias("depth")
    units = members.filter("depth > 0").select(above, "p1", "p2").unionByName(shards.select(above, "p1", "p2"))
    children = units.groupBy("depth", F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    members = members.join(children, NODE, "left_outer").withColumn("n_children", F.coalesce("n_children", none))
    booked = members.select(F.col("owner").alias("conv_id"), "depth", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    booked = paths.select("conv_id", *NODE).join(booked, ["conv_id", "depth"], "left_outer").unionByName(shards.select("conv_id", "depth", none.alias("k1"), none.alias("k2"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), ), allowMissingColumns=True)
    summed = running(booked, "conv_id", -F.col("depth"), {"n_leaves": F.coalesce("leaves", none), "saved_tokens": F.coalesce("saved", none)}, F.sum, lambda a, b: a + b)
    sums = summed.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    nodes = members.join(sums, NODE).select(F.col("owner").alias("conv_id"), *NODE, "n_convs", "n_children", "n_leaves", "saved_tokens", "end", "p1", "p2")
    nodes = stored(spark, nodes)

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
    joints = nodes.drop("k1", "k2").unionByName(shards.drop("parent_conv_id")).join(parents, ["depth", "p1", "p2"], "left_outer").select(*columns)
    whole = packed.filter("p1 is null").select(*columns).unionByName(joints)
    digests = sequences.select(F.col("conv_id").alias("end"), "ends_sha256")
    out = whole.join(digests, "end", "left_outer")
    return out.select(*columns[:-1], F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
