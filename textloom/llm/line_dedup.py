"""Line-level deduplication by winnowing: later repeats of runs of lines are deleted.

Lines without a word don't count. The run that begins at a line has as many lines as it takes to
reach WORDS words, RUN lines at most; a text of fewer lines and words is one run. So a repeat of RUN
lines is found, and one of WORDS words in whole lines, however few or long they are. Of each run's
line hashes the smallest (the last of equals) is a fingerprint, so equal runs have one at the same
place. Fingerprints that occur twice are extended both ways to the runs that contain them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textarrays as ta
from .repeated_runs import repeated_runs, with_row_ids
from .shared_store import fields, struct_type

#: Lines of a run, and words with which it is complete sooner.
RUN = 3
WORDS = 50


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines with a word, and the first of each row."""
    starts, ends, first = ta.tokens(data, offsets, ta.NEWLINE_SEPARATOR)
    solid = np.concatenate([[0], np.cumsum(~ta.SPACE_SEPARATORS[data])])
    full = solid[ends] > solid[starts]
    first = np.concatenate([[0], np.cumsum(full)])[first]
    return starts[full], ends[full], first


def run_lengths(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, run: int, words: int) -> np.ndarray:
    """Lines of the run that begins at each line: 0 where none does, negative for a text that is one run as a whole."""
    begins = ta.tokens(data, offsets, ta.SPACE_SEPARATORS)[0]
    n = len(starts)
    counts = np.searchsorted(begins, ends) - np.searchsorted(begins, starts)
    sums = np.concatenate([[0], np.cumsum(counts)])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.arange(n)
    out = np.zeros(n, np.int64)
    for k in range(run, 0, -1):  # the shortest that reaches the words comes last
        complete = sums[np.minimum(at + k, n)] - sums[at] >= words if k < run else np.ones(n, bool)
        out[complete & (left >= k)] = k
    rows = np.diff(first)
    whole = first[:-1][(rows > 0) & (rows < run)]
    whole = whole[out[whole] == 0]
    out[whole] = -left[whole]
    return out


def line_runs(run: int, words: int):
    def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = _lines(data, offsets)
        return ta.token_hashes(data, starts, ends), first, run_lengths(data, offsets, starts, ends, first, run, words)

    return units


def winnow(u: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints: for each run its smallest line hash, the last of equals."""
    begin = np.flatnonzero(lengths)
    own = np.abs(lengths[begin])
    best, at = u[begin].copy(), begin.copy()
    for k in range(1, int(own.max(initial=1))):
        reaches = np.flatnonzero(own > k)
        value = u[begin[reaches] + k]
        less = value <= best[reaches]
        best[reaches[less]] = value[less]
        at[reaches[less]] = begin[reaches[less]] + k
    at = np.unique(at)
    return at, u[at]


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without lines that repeat: columns of docs, and n_lines, n_removed_lines (bigint).

    A line goes if it stands in a run (``run`` consecutive lines of those with a word, or fewer with
    ``words`` words, or all lines of a text that has less of both) that already occurred, in a row with
    a smaller id (nulls last; of equal ids by row number) or higher up in the same text. Lines are
    compared byte by byte; lines without a word between deleted lines stay. Null and empty texts stay
    as they are; of repeated rows the first stays. If docs has n_chars, it becomes the code points of
    the new text. Columns with the names of added ones are replaced, any other stays.
    """
    added = {"n_lines": "bigint", "n_removed_lines": "bigint"}
    rows = with_row_ids(docs, id_col)
    found = repeated_runs(rows, text_col, line_runs(run, words), winnow, 1, run, keep_first=True, wide=True)
    joined = rows.join(found.withColumnRenamed("row", "_row"), "_row", "left_outer")
    kept = [c for c in docs.columns if c not in added]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone_counts = [], [], []
            for text, ats in zip(pc.struct_field(batch.column("doc"), text_col), batch.column("ats"), strict=True):
                raw = (text.as_py() or "").encode()
                data = np.frombuffer(raw, np.uint8)
                offsets = np.array([0, len(raw)])
                starts, ends, first = _lines(data, offsets)
                gone = np.zeros(len(starts), bool)
                if ats.is_valid:
                    edge = np.zeros(len(starts) + 1, np.int64)
                    at = ats.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.abs(run_lengths(data, offsets, starts, ends, first, run, words)[at]), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                counts.append(len(starts))
                gone_counts.append(int(gone.sum()))
                if gone.any():
                    parts, at = [], 0
                    for a, b in zip(starts[gone].tolist(), ends[gone].tolist(), strict=True):
                        parts.append(raw[at:a])
                        at = b + 1  # with its newline
                    texts.append(b"".join([*parts, raw[at:]]).decode())
                else:
                    texts.append(text.as_py())
            doc = batch.column("doc")
            parts = {f.name: pc.struct_field(doc, f.name) for f in doc.type}
            if "n_chars" in parts:
                parts["n_chars"] = pa.array([len(t) if g else o for t, g, o in zip(texts, gone_counts, parts["n_chars"].to_pylist(), strict=True)], parts["n_chars"].type)
            parts[text_col] = pa.array(texts, parts[text_col].type)
            edited = pa.StructArray.from_arrays(list(parts.values()), fields=list(doc.type))
            yield pa.RecordBatch.from_arrays([edited, pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64())], names=["doc", *added])

    done = joined.mapInArrow(edit, ", ".join([f"doc {struct_type(docs)}"] + [f"{c} {t}" for c, t in added.items()]))
    return done.select(*fields(docs, kept), *added)
