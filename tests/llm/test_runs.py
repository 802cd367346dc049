"""Line dedup against brute force, wide hashes, clashing names."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import line_dedup, near_dup, repeated_runs, substring_dedup

DOCS = "doc_id bigint, text string, n_chars bigint"


def runs(lines, run=3, words=50):
    """(first line, lines, key) of each run of a text's lines with a word."""
    out = []
    for i in range(len(lines)):
        total = 0
        for k in range(1, run + 1):
            if i + k > len(lines):
                break
            total += len(lines[i + k - 1].split())
            if total >= words or k == run:
                out.append((i, k, (0, *lines[i : i + k])))
                break
        else:
            continue
    if lines and len(lines) < run and not any(i == 0 for i, *_ in out):
        out.append((0, len(lines), (1, *lines)))
    return sorted(out)


def brute(rows):
    """Texts after dedup, in the order of rows with distinct ids."""
    seen, out = set(), {}
    for k, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        every = (text or "").split("\n")
        at = [n for n, line in enumerate(every) if line.strip(" \t\n\r\v\f")]
        gone = set()
        for i, n, key in runs([every[x] for x in at]):
            if key in seen:
                gone.update(at[i : i + n])
            seen.add(key)
        last = len(every) - 1
        out[k] = text if not gone else "".join(line + "\n" * (n < last) for n, line in enumerate(every) if n not in gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(6)
    pool = [f"line {k}" for k in range(12)] + ["", " \t", "long " * 49 + "x", "w " * 60 + "end", "y " * 30, "z " * 30]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "short"), (503, "short"), (504, "short\n"), (None, "w " * 60 + "end"), (505, "q " * 300_000)]
    df = spark.createDataFrame([(k, t, -1) for k, t in rows], DOCS)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df.repartition(5)).collect()}
    expected = brute(rows)
    assert {k: r.text for k, r in got.items()} == expected
    assert all(r.n_chars == (len(r.text) if r.n_removed_lines else -1) for r in got.values())
    assert sum(r.n_removed_lines for r in got.values()) > 100 and line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_a_repeated_passage_of_fifty_words_goes_however_its_lines_fall(spark):
    passage = [f"p{k}" for k in range(60)]
    for width in (60, 30, 20):
        lines = "\n".join(" ".join(passage[k : k + width]) for k in range(0, 60, width))
        rows = [(1, f"own one\n{lines}\nend one", 0), (2, f"own two\n{lines}\nend two", 0)]
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == {1: rows[0][1], 2: "own two\nend two"}


def test_equal_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 5), (1, "a\nb\nc", 5), (2, "a\nb\nd", 5)], DOCS)
    clash = df.withColumns({c: F.lit("mine") for c in ("_row", "_rank", "doc", "ats", "row", "at", "k", "node", "bucket")})
    for done in (line_dedup.dedup_lines(clash), substring_dedup.dedup_substrings(clash), near_dup.keep_one_of_each(clash)):
        assert all(r._row == r.doc == r.ats == "mine" for r in done.collect())
    assert Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(clash).collect()) == Counter([(1, "a\nb\nc"), (1, ""), (2, "a\nb\nd")])
    assert near_dup.near_duplicates(clash).count() == 3 and near_dup.keep_one_of_each(clash).columns == clash.columns


@pytest.mark.parametrize("keep_first", [False, True])
def test_equal_first_words_of_a_hash_are_told_apart_by_further_bits(keep_first):
    make = lambda rows: repeated_runs._settled(*(np.array(x) for x in zip(*rows)), True)
    # hash, further bits, rank, row, position: three equal hashes, two of them equal in all bits
    batch = make([(np.uint64(5), 1, 0, 10, 0), (np.uint64(5), 2, 1, 11, 3), (np.uint64(7), 0, 1, 12, 4)])
    other = make([(np.uint64(5), 2, 2, 20, 6)])
    rows = sorted((r for b in (batch, other) for r in b.to_pylist()), key=lambda r: (r["at"] & 3 == 2, r["k"], r["at"] >> 34, r["rank"]))
    import pyarrow as pa

    got = [(r["row"], r["at"]) for b in repeated_runs._again([pa.RecordBatch.from_pylist([r]) for r in rows], keep_first) for r in b.to_pylist()]
    assert sorted(got) == ([(20, 6)] if keep_first else [(11, 3), (20, 6)])
