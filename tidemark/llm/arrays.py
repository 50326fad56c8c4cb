"""Vectorised views of text columns: whole Arrow batches as byte arrays, words as hashes.

Nothing here loops over words in Python. A word's hash is a polynomial in its bytes (from one running sum
over the batch) passed through an avalanche mix, 64 bits wide.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once: bounds the temporary arrays (eight bytes a byte) whatever a batch holds.
SLICE_BYTES = 2 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: ASCII white space: \\x20 and \\x09-\\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but 0-9, A-Z, a-z and bytes of code points from \\x80 on.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about `limit` bytes.

    A null text is an empty one. A single longer text makes a run of its own.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, whole[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside `gap` (a table of 256), never across rows; words before each row."""
    edge = np.zeros(len(data) + 1, bool)
    inside = ~gap[data]
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = True, True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    if len(data):
        real = inside[np.minimum(starts, len(data) - 1)] & (ends > starts)
        starts, ends = starts[real], ends[real]
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, _P_INVERSE if inverse else _P, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _table(n: int, inverse: bool) -> np.ndarray:
    """At least n powers; sizes are rounded up, so few tables are ever made."""
    return _powers(SLICE_BYTES + 8 if n <= SLICE_BYTES + 8 else 1 << (n - 1).bit_length(), inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table(len(data) + 1, False)[: len(data)], dtype=np.uint64, out=running[1:])
    return mix((running[ends] - running[starts]) * _table(len(data) + 1, True)[starts])


def joined_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = words[:n]
    for i in range(1, k):
        out = mix(out * _P + words[i : i + n])
    return out


def distinct_in_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, in order of row, then value.

    Row and leading bits of the value are sorted as one number; should two values of a row differ only behind those
    bits, the full sort is done instead.
    """
    if not len(rows):
        return rows, values
    room = 64 - max(1, int(rows.max()).bit_length())
    joint = rows.astype(np.uint64) << np.uint64(room) | values >> np.uint64(64 - room)
    order = np.argsort(joint)
    joint, rows, values = joint[order], rows[order], values[order]
    same, new = joint[1:] == joint[:-1], np.ones(len(rows), bool)
    new[1:] = ~same
    if (same & (values[1:] != values[:-1])).any():
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def binary_column(blob: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows take `counts` items of the array, one after another."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts, np.int64) * blob.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(blob))]).cast(pa.binary())


@lru_cache(1)
def _settled() -> None:
    """Once in a worker: what was imported is left out of later collections, which would take most of a short task."""
    gc.freeze()


def tidied(run: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back to the system when its task ends.

    Workers live on from one operator to the next; without this, each keeps the most it ever needed.
    """

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            _settled()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return outer
