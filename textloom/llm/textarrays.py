"""Numpy views of Arrow string columns: word boundaries and hashes for whole slices of documents.

A slice is a range of whole rows whose texts hold at most ``SLICE_BYTES`` bytes (one row at
least), so that temporary arrays stay small whatever the Arrow batch size. Null counts as "".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_U = np.uint64
_WORD_BASE = _U(0x9E3779B97F4A7C15)
_PAIR_BASE = _U(0xD6E8FEB86659FD93)

#: Words are runs of bytes other than space and \t..\r.
SPACE_SEPARATORS = np.zeros(256, bool)
SPACE_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE_SEPARATOR = np.zeros(256, bool)
NEWLINE_SEPARATOR[0x0A] = True
#: Everything in ASCII but letters separates.
NON_LETTERS = np.zeros(256, bool)
NON_LETTERS[:0x80] = True
NON_LETTERS[0x41:0x5B] = NON_LETTERS[0x61:0x7B] = False

SAME_BYTES = np.arange(256, dtype=np.uint8)
ASCII_LOWER = SAME_BYTES.copy()
ASCII_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for slices of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()) if len(column) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def tokens(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in ``data``) of the tokens between separator bytes, and the first token of each row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)  # a row's first byte starts anew
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(starts)
    ends = inside[:-1].copy()
    ends &= ~inside[1:] | edge[1:]
    ends = np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME_BYTES) -> np.ndarray:
    """A 64-bit hash of each token's bytes (after ``fold``), the same in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    cum = np.cumsum(lengths)
    within = np.arange(cum[-1]) - np.repeat(cum - lengths, lengths)
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(int(lengths.max()), _WORD_BASE)]))
    # between separators only the tokens' own bytes are taken
    at = within + np.repeat(starts, lengths)
    values = (fold[data[at]].astype(np.uint64) + _U(1)) * powers[within]
    return mix(np.add.reduceat(values, cum - lengths) + lengths.astype(np.uint64) * _PAIR_BASE)


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive elements of h, by doubling."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    rest = length
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = mix(part + _WORD_BASE) if out is None else mix(out * _PAIR_BASE + part)
            done += size
        rest >>= 1
        if rest:
            power = mix(power[:-size] * _PAIR_BASE + power[size:] + _U(size))
            size *= 2
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
