"""Benchmark decontamination against brute force, by broadcast and by shuffle."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    some = lambda n: [f"w{rnd.randrange(30)}" for _ in range(n)]
    items = [(1, " ".join(some(25)).upper() + "!"), (2, "Only, THREE words"), (3, None), (None, "a null id, with exactly ten words in it, é ok"), (4, " - "), (5, " ".join(some(10))), (10, "Only three words")]
    rows = []
    for k in range(40):
        body = some(rnd.randrange(30))
        item = words(items[rnd.choice([0, 1, 3, 5])][1])
        at = rnd.randrange(len(item))
        rows.append((k, "; ".join(body + item[at - at % 2 * at :] + some(rnd.randrange(8)))))
    rows += [(100, None), (101, ""), (7, rows[7][1]), (7, rows[8][1]), (None, "only three WORDS here"), (102, "long " * 60_000 + "only three words")]
    docs = spark.createDataFrame([(k, t, "s", 5) for k, t in rows], "doc_id bigint, text string, items string, n_chars int").repartition(3)
    return rows, items, docs, spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("most", [dc.BROADCAST_BYTES, -1])
def test_against_brute_force(tables, monkeypatch, most):
    rows, items, docs, bench = tables
    monkeypatch.setattr(dc, "BROADCAST_BYTES", most)
    grams = {}
    for k, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if k is None else str(k))
    expected, left = Counter(), Counter()
    for k, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    ids |= grams[g]
        expected[k, len(w), len(hit), tuple(sorted(ids)), bool(hit)] += 1
        spots = iter(range(len(w)))
        left[k, text if text is None else re.sub(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lambda m: "" if next(spots) in hit else m[0], text)] += 1
    got = dc.contamination(docs, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got) == expected
    assert all(r.n_items == len(r.item_ids) for r in got)
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(k for k, *_, bad in expected.elements() if not bad)
    cut = dc.remove_spans(docs, bench).collect()
    assert Counter((r.doc_id, r.text) for r in cut) == left and all(r.items == "s" for r in cut)
    assert all(r.n_chars == 5 or r.n_chars == len(r.text) for r in cut)


def test_empty_tables_and_clashing_columns(tables):
    rows, _, docs, bench = tables
    clash = docs.withColumns({c: F.lit("mine") for c in ("id", "pos", "w", "h", "_id", "_doc", "gram")})
    assert dc.contamination(clash, bench.withColumn("gram", F.lit(1))).count() == len(rows)
    assert dc.decontaminate(clash, bench).columns == clash.columns and dc.remove_spans(clash, bench).first()._doc == "mine"
    assert dc.contamination(docs.limit(0), bench).count() == 0
    assert not dc.contamination(docs, bench.limit(0)).filter("contaminated").count()
