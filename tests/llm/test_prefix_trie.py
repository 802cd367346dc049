"""The prefix trie against sets of prefixes in plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from textloom.llm import prefix_trie as pt
from textloom.operators import positions

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]  # the remainder has the sign of c, as in SQL
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(list), {}, {}
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=90, most=14):
    rnd = random.Random(seed)
    rows = [(c, k or None, rnd.choice(["user", "assistant", None]), rnd.choice(["x", "yy", "é", None, ""])) for c in range(n) for k in range(rnd.randrange(most))]
    rows += [(c, k, "user", f"same {k}") for c in range(200, 240) for k in range(12)]  # copies
    rows += [(400 + k, 0, "system", "hello") for k in range(60)]  # a hot first turn
    rows += [(400 + k, 1, "user", str(k % 25)) for k in range(60)]
    return rows


@pytest.mark.parametrize("most", [None, 1, 25])
def test_nodes_against_sets_of_prefixes(spark, most):
    rows = conversations(4)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], TURNS + ", depth int, k1 string")
    assert sorted(map(tuple, pt.prefix_trie(df.repartition(5), most).collect()), key=str) == plain(rows)


def test_long_conversations_in_blocks_and_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK", 7)
    rnd = random.Random(1)
    said = [f"t{rnd.randrange(3)}" for _ in range(300)]
    rows = [(c, k, "user", x) for c in (5, 7, 11, 16) for k, x in enumerate(said[: 300 - 3 * c])] + [(16, 400, "user", "long " * 200_000)]
    for most in (3, None):
        assert sorted(map(tuple, pt.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(9), most).collect()), key=str) == plain(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 1, "user", "gone"), (1, None, None, None), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, None, "user", "a"), (-3, 0, "user", "a")]
    got = pt.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert sum(r.n_convs for r in got if r.depth == 0) == 3
    assert pt.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_double_array_holds_what_was_packed():
    rnd = random.Random(8)
    for most in (2, 5, 400):
        found = {tuple((rnd.randrange(most), 1) for _ in range(rnd.randrange(7))) for _ in range(500)}
        trie, dense, states = pt.pack([list(s) for s in found])
        prefixes = {s[:k] for s in found for k in range(len(s) + 1)}
        assert len(states) == len(set(states)) == len(prefixes) and sorted(dense.values()) == list(range(len(dense)))
        reached = set()
        for s in prefixes:
            state = 0
            for turn in s:
                state = trie.next(state, dense[turn])
            reached.add(state)
            for turn, code in dense.items():
                assert (trie.next(state, code) is not None) == (s + (turn,) in prefixes)
        assert reached == set(states)
        assert len(trie.base) <= len(states) + 2 * len(dense) + 64  # packed
