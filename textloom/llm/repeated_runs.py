"""Runs of units (words or lines) that occur more than once, found by anchors that any two of them share.

A run begins at a unit and has a length that depends only on the units from there on, so equal
passages have equal runs.

1. Each row of documents gives anchors: hashes of short runs at positions chosen so that any two
   equal runs have an anchor at the same place in each.
2. Anchors are dealt by hash; those that occur twice are shared.
3. Around the shared anchors of a row, every run that contains one is hashed.
4. These hashes are dealt again; the positions that stand twice come back to their rows.

No pairs are made at any point. A hash that stands often in one slice of rows (a passage that a
third of the corpus has) is settled in the slice: one carrier goes to the hash's partition, the
others go to partitions by their row and are known to be shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared_store import numbered

#: What a slice of rows gives: unit hashes, the first unit of each row (one entry more than rows), and the length of
#: the run that begins at each unit (0: none; minus the length if it is the whole row, and equal to whole rows alone).
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Positions (in the slice's units) and hashes of the anchors, from what Units gives.
Anchors = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

#: k: the hash, or for settled rows the row. at: 4 * position + state, which is 0 for what stands alone in its
#: slice, 1 for the carrier of a shared hash, 2 for settled rows; above POSITION_BITS, further bits of the hash.
#: rank stands only where order counts.
SEEN = "k bigint, row bigint, at bigint"
RANKED = SEEN + ", rank bigint"
POSITION_BITS = 34


def with_row_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """doc, _row (a number for each row, the same in every job) and _rank, which orders rows: their integer id where it is one, nulls last."""
    rank = F.coalesce(F.col("doc").getField(id_col).cast("bigint"), F.lit(2**63 - 1)) if id_col in docs.columns else F.lit(0).cast("bigint")
    return numbered(docs).withColumn("_rank", rank)


def _settled(h: np.ndarray, more: np.ndarray, rank: np.ndarray, row: np.ndarray, at: np.ndarray, ranked: bool) -> pa.RecordBatch:
    """Rows of SEEN or RANKED for one slice; of equal hashes (h and more) the first in order is the carrier."""
    order = np.lexsort((at, row, rank, more, h))
    h, more, rank, row, at = h[order], more[order], rank[order], row[order], at[order]
    same = (h[1:] == h[:-1]) & (more[1:] == more[:-1])
    later = np.concatenate([[False], same])
    state = np.where(later, 2, np.concatenate([same, [False]]))
    key = np.where(later, row, ta.signed(h))
    columns = {"k": key, "row": row, "at": (np.where(later, 0, more) << POSITION_BITS) | (at * 4 + state)} | ({"rank": rank} if ranked else {})
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], names=list(columns))


def _again(batches: Iterator[pa.RecordBatch], keep_first: bool) -> Iterator[pa.RecordBatch]:
    """From a partition sorted by (settled, k, further bits, order): row and position of what is shared.

    keep_first leaves out the first in order of each hash. Only the current batch and the last
    row of the one before are held, however often a hash stands.
    """
    held = None  # the last carrier: (k, further bits, row, at, told)
    for batch in batches:
        k, row, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "row", "at"))
        at, state, more = ((at & ((1 << POSITION_BITS) - 1)) >> 2).astype(np.int32), at & 3, at >> POSITION_BITS
        settled = state == 2
        rows, ats = [row[settled]], [at[settled]]
        k, row, at, state, more = (x[~settled] for x in (k, row, at, state, more))
        if len(k):
            joins = held is not None and held[:2] == (k[0], more[0])
            equal = (k[1:] == k[:-1]) & (more[1:] == more[:-1])
            take = np.concatenate([[joins], equal])
            if not keep_first:
                take |= np.concatenate([equal, [False]]) | (state == 1)
                if joins and not held[4]:
                    rows.append(np.array([held[2]]))
                    ats.append(np.array([held[3]], np.int32))
            held = (k[-1], more[-1], row[-1], at[-1], bool(take[-1]))
            rows.append(row[take])
            ats.append(at[take])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).astype(np.int64)), pa.array(np.concatenate(ats).astype(np.int32))], names=["row", "at"])


def _deal(seen: DataFrame, keep_first: bool) -> DataFrame:
    order = [F.col("at").bitwiseAND(3) == 2, F.col("k"), F.shiftright("at", POSITION_BITS)] + [F.col(c) for c in ("rank", "row", "at") if keep_first]
    dealt = seen.repartition("k").sortWithinPartitions(*order).select("k", "row", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _again(batches, keep_first)

    return dealt.mapInArrow(run, "row bigint, at int")


def _by_row(found: DataFrame) -> DataFrame:
    return found.groupBy("row").agg(F.collect_list("at").alias("ats"))


def run_hashes(u: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the runs that begin at these units."""
    out = np.zeros(len(begin), np.uint64)
    own = lengths[begin]
    for n in np.unique(own):
        here = own == n
        out[here] = ta.window_hashes(u, abs(int(n)))[begin[here]]
        if n < 0 or len(np.unique(own)) > 1:
            out[here] = ta.mix(out[here] + np.uint64(2 * abs(int(n)) + (n < 0)))
    return out


def repeated_runs(rows: DataFrame, text_col: str, units: Units, anchors: Anchors, anchor_length: int, longest: int, keep_first: bool, wide: bool = False) -> DataFrame:
    """row, ats: the first units of the runs (of at most ``longest`` units) that occur again.

    Runs are equal if their hashes are: 64 bits, or with ``wide`` 92.

    rows has _row, _rank and doc with the text; a caller that joins the result with the same rows shares
    their exchange. keep_first leaves out the first occurrence, in the order
    of (_rank, _row, position). Positions count units in the row's whole text from 0.
    """
    text = rows.select("_row", "_rank", F.col("doc").getField(text_col).alias("text"))

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_row", "_rank"))
            for first, last, data, offsets in ta.text_slices(batch.column("text")):
                u, starts, lengths = units(data, offsets)
                at, h = anchors(u, starts, lengths)
                of = np.searchsorted(starts, at, "right") - 1
                yield _settled(h, np.zeros(len(h), np.int64), rank[first:last][of], row[first:last][of], at - starts[of], False)

    shared = _by_row(_deal(text.mapInArrow(find_anchors, SEEN), keep_first=False))
    # all columns, as a caller's join has them, so that both read one exchange
    near = rows.join(shared.withColumnRenamed("row", "_row"), "_row")

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_row", "_rank"))
            ats = batch.column("ats")
            counts = ats.value_lengths().to_numpy(zero_copy_only=False)
            flat, cum = ats.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])
            for first, last, data, offsets in ta.text_slices(pc.struct_field(batch.column("doc"), text_col)):
                u, starts, lengths = units(data, offsets)
                n = len(u)
                at = flat[cum[first] : cum[last]] + np.repeat(starts[:-1], counts[first:last])
                # runs that reach over [at, at + anchor_length) are among those that begin here
                edge = np.zeros(n + 2, np.int32)
                np.add.at(edge, np.maximum(at + anchor_length - longest, 0), 1)
                np.add.at(edge, at + 1, -1)
                begin = np.flatnonzero((np.cumsum(edge)[:n] > 0) & (lengths != 0))
                if not len(begin):
                    continue
                h = run_hashes(u, begin, lengths)
                more = ta.signed(run_hashes(ta.mix(u + np.uint64(0x9E3779B97F4A7C15)), begin, lengths) >> np.uint64(64 - 28)) if wide else np.zeros(len(h), np.int64)
                of = np.searchsorted(starts, begin, "right") - 1
                yield _settled(h, more, rank[first:last][of], row[first:last][of], begin - starts[of], keep_first)

    return _by_row(_deal(near.mapInArrow(find_runs, RANKED if keep_first else SEEN), keep_first))
