"""Vector codes: each vector's parts replaced by the nearest entries of exact integer codebooks.

Components become floor(SCALE * x). A vector is cut into PARTS equal parts, and each part position
has a codebook of ENTRIES entries, begun with the parts of the smallest vector ids and moved by
ROUNDS rounds of assignment and componentwise floor of the mean. All of it is in whole numbers, so
the codes don't depend on how rows are dealt.

Blocks. Rows are kept in groups of GROUP rows at most. For each part position the points of a group
are sorted along a Hilbert curve and cut into blocks of BLOCK points, which carry their minimum and
maximum in every dimension and their sum. A round takes, for each block, the distances of its box
from all entries: an entry whose least distance is more than the largest distance of another can't
be nearest to any of its points, nor one that is farther away than that other all over the box. The
rest is the block's shortlist. A block with one entry on it
adds its stored sum; the points of others meet their shortlist in an integer kernel. The groups are
written once to the shared folder; a round reads them and shuffles counts and sums of entries only.
Codebooks (64 x dimension numbers) are all that comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_store import bounded_batches, stored

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows of a group and points of a block.
GROUP = 4096
BLOCK = 16
#: Labels up to whose number their sums are broadcast (16 bytes each); beyond it they are dealt, each to SALTS buckets.
BROADCAST_LABELS = 200_000
SALTS = 8
#: Bits of a Hilbert index over all dimensions.
_CURVE_BITS = 60


def hilbert_index(points: np.ndarray) -> np.ndarray:
    """The place of each point (row of whole numbers) on a Hilbert curve through the box of all of them.

    Coordinates are cut to as many bits as 60 allow for all dimensions, and dimensions beyond 60 don't
    count: it orders points, so that neighbours are close, and need not tell them apart.
    """
    x = points[:, :_CURVE_BITS]
    n, dims = x.shape
    if not n or not dims:
        return np.zeros(n, np.int64)
    bits = _CURVE_BITS // dims
    x = x - x.min(axis=0)
    x = (x >> max(0, int(x.max()).bit_length() - bits)).astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the curve in smaller and smaller cubes
        low = q - 1
        for d in range(dims):
            inside = (x[d] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn, q = np.zeros(n, np.int64), top
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[d] >> b) & 1)
    return place


class PartBlocks:
    """The points of one part position in a group: sorted, in blocks with boxes and sums."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        """points: rows of whole numbers; in the order given, or else unsorted."""
        if order is None:
            order = np.argsort(hilbert_index(points), kind="stable")
            points = points[order]
        self.points, self.order = points, order
        starts = np.arange(0, len(points), BLOCK)
        self.counts = np.diff(np.append(starts, len(points)))
        self.low, self.high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        self.sums = np.add.reduceat(points, starts)

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """For each block (row) the entries (columns) that may be nearest to one of its points."""
        below, above = self.low[:, None] - entries, entries - self.high[:, None]
        out = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        least, most = (out * out).sum(axis=2), (far * far).sum(axis=2)
        short = least <= most.min(axis=1, keepdims=True)
        # nor can one be for which the entry of the least largest distance is nearer all over the box; the difference of both is linear, so a corner decides
        gap = entries[most.argmin(axis=1)][:, None] - entries
        squares = (entries * entries).sum(axis=1)
        ahead = squares[most.argmin(axis=1)][:, None] - squares + np.maximum(-2 * self.low[:, None] * gap, -2 * self.high[:, None] * gap).sum(axis=2)
        return short & (ahead >= 0)

    def assign(self, entries: np.ndarray, distances: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """The nearest entry of each point in curve order, ties to the lower index; its squared distance if asked for; which blocks have one entry on their shortlist."""
        short = self.shortlists(entries)
        sizes = short.sum(axis=1)
        best = np.zeros(len(self.points), np.int64)
        far = np.zeros(len(self.points), self.points.dtype) if distances else None
        first = np.arange(len(sizes)) * BLOCK
        for size in np.unique(sizes):
            if size == 1 and not distances:
                continue
            blocks = np.flatnonzero(sizes == size)
            at = np.minimum(first[blocks, None] + np.arange(BLOCK), (first + self.counts - 1)[blocks, None])  # the last block repeats its last point
            chosen = np.nonzero(short[blocks])[1].reshape(len(blocks), size)
            step = max(1, (1 << 20) // (BLOCK * size * max(1, self.points.shape[1])))
            for k in range(0, len(blocks), step):
                some, own = at[k : k + step], chosen[k : k + step]
                gap = self.points[some][:, :, None, :] - entries[own][:, None, :, :]
                near = (gap * gap).sum(axis=3)
                pick = near.argmin(axis=2)
                best[some] = np.take_along_axis(own, pick, 1)
                if distances:
                    far[some] = np.take_along_axis(near, pick[:, :, None], 2)[:, :, 0]
        alone = sizes == 1
        if not distances and alone.any():
            best[np.repeat(alone, self.counts)] = np.repeat(short[alone].argmax(axis=1), self.counts[alone])
        return best, far, alone

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the points that each entry is nearest to."""
        best, _, alone = self.assign(entries, False)
        count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, self.points.dtype)
        single = best[np.arange(len(alone)) * BLOCK][alone]
        np.add.at(count, single, self.counts[alone])
        np.add.at(total, single, self.sums[alone])
        rest = ~np.repeat(alone, self.counts)
        np.add.at(count, best[rest], 1)
        np.add.at(total, best[rest], self.points[rest])
        return count, total


def fitting(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where no squared distance of a part leaves them, else as Python's."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int64 if 8 * (most + 1) ** 2 * max(1, points.shape[1]) < 1 << 63 else object
    return points.astype(kind), entries.astype(kind)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows whose vector is whole: not null, without null or non-finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & ~odd)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles; those beyond 2^62 are an error (their squares fit no error column)."""
    scaled = np.floor(values * SCALE)
    if len(scaled) and np.abs(scaled).max(initial=0) >= 2.0**62:
        raise ValueError("a component is too large to be coded")
    return scaled.astype(np.int64)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) and list(lengths) != [dimension]:
        raise ValueError(f"vectors of {sorted(map(int, lengths))} components, where the first has {dimension}")
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dimension)


_GROUP_SCHEMA = "ids array<bigint>, labels array<bigint>, points binary, orders binary"


def grouped(kept: DataFrame, dimension: int) -> DataFrame:
    """Groups of rows: ids and labels, and for each part position its points along the curve and their places in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                parts = _matrix(some.column("embedding"), dimension).reshape(some.num_rows, PARTS, dimension // PARTS)
                blocks = [PartBlocks(parts[:, p]) for p in range(PARTS)]
                points = np.stack([b.points for b in blocks])
                small = np.abs(points).max(initial=0) < 1 << 31
                arrays = [pa.array([some.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("vec_id", "label")]
                arrays += [pa.array([points.astype("<i4" if small else "<i8").tobytes()], pa.binary()), pa.array([np.stack([b.order for b in blocks]).astype("<i2").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["ids", "labels", "points", "orders"])

    bounded_batches(kept.sparkSession)
    return kept.mapInArrow(run, _GROUP_SCHEMA)


def _read(row: dict, dimension: int) -> Iterator[PartBlocks]:
    n, wide = len(row["ids"]), dimension // PARTS
    data = row["points"]
    kind = "<i8" if n and wide and len(data) == 8 * n * dimension else "<i4"
    points = np.frombuffer(data, kind).reshape(PARTS, n, wide).astype(np.int64)
    orders = np.frombuffer(row["orders"], "<i2").reshape(PARTS, n)
    for p in range(PARTS):
        yield points[p], orders[p]


def _totals(groups: DataFrame, codebooks: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> count and sum of its points; summed in tasks, then by (part, entry)."""
    parts, entries, wide = codebooks.shape
    names = [f"s{d}" for d in range(wide)]
    books = codebooks.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), object)
        for batch in batches:
            for row in batch.to_pylist():
                for p, (points, order) in enumerate(_read(row, parts * wide)):
                    points, own = fitting(points, np.array(books[p], object).reshape(entries, wide))
                    count, total = PartBlocks(points, order).totals(own)
                    counts[p] += count
                    sums[p] += total
        at = np.argwhere(counts > 0)
        if len(at):
            arrays = [pa.array(at[:, k], pa.int32()) for k in (0, 1)] + [pa.array(counts[counts > 0], pa.int64())]
            arrays += [pa.array([str(v) for v in sums[counts > 0][:, d]], pa.string()) for d in range(wide)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", *names])

    made = groups.select("ids", "points", "orders").mapInArrow(run, f"part int, entry int, n bigint{''.join(f', {c} string' for c in names)}")
    summed = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names))
    return {(r.part, r.entry): (r.n, [int(r[c]) for c in names]) for r in summed.collect()}  # PARTS x ENTRIES rows at most


_CODED_SCHEMA = "vec_id bigint, label bigint, code string, error bigint"


def _codes(groups: DataFrame, codebooks: np.ndarray) -> DataFrame:
    parts, entries, wide = codebooks.shape
    books = codebooks.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, object)
                for p, (points, order) in enumerate(_read(row, parts * wide)):
                    points, own = fitting(points, np.array(books[p], object).reshape(entries, wide))
                    best, far, _ = PartBlocks(points, order).assign(own, True)
                    codes[order, p] = best
                    errors[order] += far.astype(object)
                text = codes.tobytes().hex()
                arrays = [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array([text[2 * parts * k : 2 * parts * (k + 1)] for k in range(n)], pa.string()), pa.array(errors.tolist(), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    return groups.mapInArrow(run, _CODED_SCHEMA)


def first_codebooks(kept: DataFrame) -> np.ndarray | None:
    """part x entry x component: the parts of the vectors of the smallest ids (null last; repeated ids by their components); None without vectors."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    if not rows:
        return None
    sizes = {len(r.embedding) for r in rows}
    if len(sizes) > 1 or min(sizes) % PARTS:
        raise ValueError(f"vectors of {sorted(sizes)} components can't be cut into {PARTS} equal parts")
    values = whole_numbers(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), min(sizes)))
    return values.reshape(len(rows), PARTS, -1).transpose(1, 0, 2).astype(object)


def moved(codebooks: np.ndarray, totals: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    """The componentwise floor of the mean for entries with points; the others stay."""
    out = codebooks.copy()
    for (part, entry), (n, sums) in totals.items():
        out[part, entry] = [s // n for s in sums]
    return out


def compress_vectors(vectors: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code, error of each whole vector, and the final codebooks (part x entry x component).

    Rows with a null vector, or null or non-finite components, go; null ids and labels, repeated ids
    and equal vectors stay rows of their own; further columns aren't read. Vectors of different
    lengths, of a length that PARTS doesn't divide, or too large for a 64-bit error are errors. An
    empty table gives no rows and no codebooks.
    """
    spark, kept = vectors.sparkSession, kept_vectors(vectors)
    codebooks = first_codebooks(kept)
    if codebooks is None:
        return spark.createDataFrame([], _CODED_SCHEMA), None
    dimension = codebooks.shape[0] * codebooks.shape[2]
    groups = stored(spark, grouped(kept, dimension))
    for _ in range(ROUNDS):
        codebooks = moved(codebooks, _totals(groups, codebooks))
    return _codes(groups, codebooks), codebooks


def decode(code: Column, codebooks: np.ndarray) -> Column:
    """The vector that a code stands for: the entries it names, scaled back."""
    flat = F.lit([[float(v) / SCALE for v in entry] for part in codebooks.tolist() for entry in part])
    entries = codebooks.shape[1]
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + p * entries
    return F.flatten(F.array(*(F.get(flat, index(p)) for p in range(codebooks.shape[0]))))


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in codebooks.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors of the rows of its label, nulls together), codebooks_sha256.

    Errors are summed by label in tasks first, so a label with a third of all rows is no hot key; the
    sums come back by a broadcast, or beyond BROADCAST_LABELS labels by a salted join.
    """
    coded, codebooks = compress_vectors(vectors)
    if codebooks is None:
        return coded.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = stored(vectors.sparkSession, coded).withColumn("own", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label")))
    sums = rows.groupBy("own").agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        joined = rows.join(F.broadcast(sums), "own")
    else:
        spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(spread, ["own", "salt"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
