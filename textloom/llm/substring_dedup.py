"""Exact substring deduplication by difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: every residue is a difference of two of its
elements. So for any two positions i and j some d below PERIOD puts both i + d and j + d on cover
positions, and two equal windows of WINDOW words share an aligned anchor of
WINDOW - PERIOD + 1 words. Only a quarter of the positions are hashed; the windows around shared
anchors are then compared whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textarrays as ta
from .repeated_runs import repeated_runs, with_row_ids
from .shared_store import fields, struct_type

WINDOW = 35
PERIOD = 21
# A perfect difference set modulo 21.
COVER = (0, 1, 6, 8, 18)


def word_runs(window: int):
    """Words, each the first of a run of ``window`` where so many are left in its row."""

    def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = ta.tokens(data, offsets, ta.SPACE_SEPARATORS)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(starts))
        return ta.token_hashes(data, starts, ends), first, np.where(left >= window, window, 0)

    return units


def cover_anchors(length: int, period: int, cover: tuple[int, ...]):
    """Anchors of ``length`` words at positions (in their document) whose residue is in the cover."""
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True

    def anchors(u: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(starts)
        of = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(u)) - np.repeat(starts[:-1], counts)
        at = np.flatnonzero(chosen[within % period] & (within + length <= counts[of]))
        return at, ta.window_hashes(u, length)[at]

    return anchors


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_words, n_removed (bigint), kept_text and kept_sha256 to each document row.

    A word goes if a window of ``window`` words that covers it has the same word sequence as a
    window that starts anywhere else, in the same text too. Null texts have no words. Every row
    counts as a document of its own, also repeated rows and rows with equal or null ids. Texts
    shorter than a window stay whole; white space around kept words becomes one space. Columns
    of docs whose names clash with added ones are replaced.
    """
    period = PERIOD if window >= PERIOD + 8 else 1
    cover = COVER if period > 1 else (0,)
    length = window - period + 1
    added = {"n_words": "bigint", "n_removed": "bigint", "kept_text": "string", "kept_sha256": "string"}
    rows = with_row_ids(docs, id_col)
    found = repeated_runs(rows, text_col, word_runs(window), cover_anchors(length, period, cover), length, window, keep_first=False)
    joined = rows.join(found.withColumnRenamed("row", "_row"), "_row", "left_outer")
    kept = [c for c in docs.columns if c not in added]
    words = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, ats in zip(pc.struct_field(batch.column("doc"), text_col), batch.column("ats"), strict=True):
                w = words.findall((text.as_py() or "").encode())
                rest = w
                if ats.is_valid:
                    edge = np.zeros(len(w) + 1, np.int64)
                    at = ats.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    rest = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                text = b" ".join(rest)
                for column, x in zip(out, (len(w), len(w) - len(rest), text.decode(), hashlib.sha256(text).hexdigest()), strict=True):
                    column.append(x)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays], names=["doc", *added])

    done = joined.mapInArrow(run, ", ".join([f"doc {struct_type(docs)}"] + [f"{c} {t}" for c, t in added.items()]))
    return done.select(*fields(docs, kept), *added)
