"""Vector codes against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from textloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def plain(rows):
    """vec_id, code, error, label_error, digest of each row, by Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(x * 256) for x in r[1]] for r in kept]
    wide = len(whole[0]) // 16
    parts = [[w[p * wide : (p + 1) * wide] for p in range(16)] for w in whole]
    books = [[list(row[p]) for row in parts[:64]] for p in range(16)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            own = [nearest(row[p], p)[1] for row in parts]
            books[p] = [[sum(c) // own.count(k) for c in zip(*(row[p] for row, o in zip(parts, own, strict=True) if o == k), strict=True)] if k in own else e for k, e in enumerate(books[p])]
    best = [[nearest(row[p], p) for p in range(16)] for row in parts]
    errors = [sum(d for d, _ in b) for b in best]
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    sums = {}
    for r, e in zip(kept, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in b), e, sums[r[2]], digest) for r, b, e in zip(kept, best, errors, strict=True)), key=str)


def rows_of(n, dimension, seed, spread=0.3):
    rnd = random.Random(seed)
    made = [(k, [rnd.gauss(0, spread) for _ in range(dimension)], rnd.choice([0, 1, None]), "x") for k in rnd.sample(range(10 * n), n)]
    odd = [(None, made[0][1], 5, None), (made[1][0], made[1][1], made[1][2], None), (made[2][0], made[3][1], None, None), (n * 20, made[3][1], 1, "")]
    return made + odd


@pytest.mark.parametrize(("n", "dimension", "spread"), [(700, 32, 0.3), (20, 16, 2.0), (150, 48, 1e6), (130, 16, 0.001)])
@pytest.mark.parametrize("labels", [vc.BROADCAST_LABELS, 0])
def test_codes_against_plain_arithmetic(spark, monkeypatch, n, dimension, spread, labels):
    monkeypatch.setattr(vc, "BROADCAST_LABELS", labels)
    monkeypatch.setattr(vc, "GROUP", 64)
    rows = rows_of(n, dimension, n, spread)
    gone = [(1, None, 1, None), (2, [None, *[0.0] * (dimension - 1)], 1, ""), (3, [math.nan] * dimension, 1, ""), (4, [math.inf] * dimension, None, ""), (None, [-math.inf] * dimension, 1, "")]
    df = spark.createDataFrame(rows + gone, SCHEMA)
    assert sorted(map(tuple, vc.vector_codes(df.repartition(5)).collect()), key=str) == plain(rows)


def test_no_vectors_and_lengths(spark):
    none = vc.vector_codes(spark.createDataFrame([(1, None, 1, "")], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    empty = vc.vector_codes(spark.createDataFrame([(1, [], 1, ""), (2, [], None, "")], SCHEMA)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in empty) == [(1, "00" * 16, 0), (2, "00" * 16, 0)]
    for rows in ([(1, [0.0] * 16, 1, ""), (2, [0.0] * 32, 1, "")], [(1, [0.0] * 15, 1, "")]):
        with pytest.raises(ValueError, match="equal parts"):
            vc.vector_codes(spark.createDataFrame(rows, SCHEMA))


def test_shortlists_hold_every_nearest_entry():
    rnd = np.random.default_rng(2)
    for wide, spread in ((1, 3), (2, 9), (4, 40), (7, 2)):
        points, entries = rnd.integers(-spread, spread + 1, (333, wide)), rnd.integers(-spread, spread + 1, (20, wide))
        blocks = vc.PartBlocks(points)
        far = ((blocks.points[:, None] - entries) ** 2).sum(axis=2)
        best, own, _ = blocks.assign(entries, True)
        assert (best == far.argmin(axis=1)).all() and (own == far.min(axis=1)).all()
        short = np.repeat(blocks.shortlists(entries), blocks.counts, axis=0)
        assert short[far == far.min(axis=1, keepdims=True)].all()  # ties too
        count, total = blocks.totals(entries)
        assert (count == np.bincount(best, minlength=20)).all() and (total.sum(axis=0) == points.sum(axis=0)).all()
    assert vc.PartBlocks(rnd.normal(0, 60, (4096, 4)).astype(np.int64)).shortlists(rnd.normal(0, 60, (64, 4)).astype(np.int64)).mean() < 0.5


def test_curve_visits_neighbours():
    for dims, side in ((2, 16), (3, 8)):
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
        path = grid[np.argsort(vc.hilbert_index(grid), kind="stable")]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_codes_decode_to_entries(spark):
    rows = rows_of(100, 32, 9)
    coded, books = vc.compress_vectors(spark.createDataFrame(rows, SCHEMA))
    original = {(r[0]): [math.floor(x * 256) for x in r[1]] for r in rows[:100]}
    for r in coded.withColumn("back", vc.decode(coded.code, books)).filter("vec_id is not null").dropDuplicates(["vec_id"]).collect():
        if r.vec_id in original and [x[0] for x in rows].count(r.vec_id) == 1:
            assert sum((a - round(b * 256)) ** 2 for a, b in zip(original[r.vec_id], r.back, strict=True)) == r.error
