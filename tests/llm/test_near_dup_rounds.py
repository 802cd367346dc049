"""The rounds of leaders on one crowded bucket, against all pairs."""

import random
import re
from collections import Counter

import pytest

from textloom.llm import near_dup


def bag(text):
    w = text.split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_crowded_bucket_loses_no_link(spark, monkeypatch, seed):
    """Rows that share passages, some of them similar, near the threshold or not, all in the same two buckets."""
    monkeypatch.setattr(near_dup, "LEADERS", 2)
    monkeypatch.setattr(near_dup, "MET_BY_ONE_COPY", 3)
    rnd = random.Random(seed)
    passages = [" ".join(f"p{k}w{rnd.randrange(500)}" for _ in range(20)) for k in range(8)]
    rows = []
    for k in range(60):
        own = " ".join(f"r{k}w{n}" for n in range(rnd.choice([0, 6, 12, 20])))
        rows.append((k, " ".join([*(passages[i] for i in sorted(rnd.sample(range(8), 5))), own])))
    bags = [bag(t) for _, t in rows]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for j in range(i):
            if (both := (bags[i] & bags[j]).total()) >= 0.8 * (bags[i].total() + bags[j].total() - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    texts = spark.createDataFrame(rows, "row bigint, text string")
    entries = [(b, k, bags[k].total(), 1) for k in range(60) for b in (7, 8)]
    for few in (200_000, 0):
        monkeypatch.setattr(near_dup, "BROADCAST_PAIRS", few)
        got = near_dup.similar_links(spark, spark.createDataFrame(entries, "bucket bigint, row bigint, size bigint, heft bigint"), texts).collect()
        component = {r.node: r.component for r in got}
        assert [component.get(k, k) for k in range(60)] == [root(k) for k in range(60)]
    assert len({root(k) for k in range(60)}) not in (1, 60)


def test_no_link_of_the_given_documents_is_lost(spark):
    """All pairs of sf0.01 that share a shingle, by an inverted list, against the classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: (r.text or "") for r in docs.collect()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold)) for k, t in rows.items()}
    bags = {k: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter({tuple(w): 1}) for k, w in words.items() if w}
    held = {}
    for k, b in bags.items():
        for s in b:
            held.setdefault(s, []).append(k)
    shared = Counter()
    for some in held.values():
        for i, x in enumerate(some):
            for y in some[:i]:
                shared[x, y] += 1
    links = [(x, y) for x, y in shared if (both := (bags[x] & bags[y]).total()) >= 0.8 * (bags[x].total() + bags[y].total() - both)]
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        a, b = root(x), root(y)
        parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert len(links) > 50
    assert sum(got[x] == got[y] for x, y in links) >= 0.999 * len(links)  # a link is missed with a probability below 6e-5
    assert got == {k: root(k) for k in rows}
