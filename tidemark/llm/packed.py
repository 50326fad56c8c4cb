"""Records sent through an exchange as a few large rows instead of a row each.

A task gathers records of a fixed size, with a run of words each where they have any, and gives out those of a bucket
as one row once it holds LIMIT bytes. `dealt` then brings each bucket to a task of its own, which reads them as arrays.
Neither rows nor sorts of single records reach the JVM. Senders choose buckets so that each fits in a task: by counts
that were taken first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import arrays

#: Bytes that a task holds before it sends.
LIMIT = 12 << 20
SCHEMA = "bucket int, records binary, words binary"
#: A count by cell of a table; buckets that the tables are added up in.
COUNT = np.dtype([("cell", "<u4"), ("n", "<u4")])
PARTS = 16
#: Bytes of a row of records in a written table.
ROW = 1 << 20


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def take_runs(values: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of `counts` values in another order."""
    starts = np.cumsum(counts) - counts
    return values[np.repeat(starts[order], counts[order]) + ramp(counts[order])]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """One of n buckets by the leading bits of 64-bit hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def binary(blob: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows take `counts` items each."""
    blob = np.ascontiguousarray(blob)
    return arrays.binary_column(blob.view(np.uint8), np.asarray(counts) * blob.itemsize)


def joined(column: pa.Array, kind) -> np.ndarray:
    """The values of a binary column one after another, as items of a kind."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, kind)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind)


def lengths(column: pa.Array, kind) -> np.ndarray:
    """Items in each row of a binary column."""
    column = column.cast(pa.large_binary())
    return np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) // np.dtype(kind).itemsize


class Outbox:
    """Records on their way to buckets. `pick` may name those worth sending, of all that are held."""

    def __init__(self, pick: Callable[[np.ndarray], np.ndarray] | None = None):
        self.pick, self.held, self.size = pick, [], 0

    def add(self, bucket: np.ndarray, records: np.ndarray, words: np.ndarray | None = None, counts: np.ndarray | None = None) -> None:
        """Hold records, each with its bucket and `counts` words."""
        if len(bucket):
            self.held.append((bucket, records, np.zeros(0, np.uint64) if words is None else words, np.zeros(len(bucket), np.int64) if counts is None else counts))
            self.size += records.nbytes + self.held[-1][2].nbytes

    def rows(self, final: bool = False) -> Iterator[pa.RecordBatch]:
        """What is held (SCHEMA), once it is enough or nothing follows."""
        if not self.held or not (final or self.size >= LIMIT):
            return
        bucket, records, words, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.arange(len(bucket)) if self.pick is None else self.pick(records)
        order = order[np.argsort(bucket[order], kind="stable")]
        bucket = bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        many = np.diff(first, append=len(bucket))
        words, counts = take_runs(words, counts, order), counts[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[first].astype(np.int32)), binary(records[order], many), binary(words, np.add.reduceat(counts, first))], ["bucket", "records", "words"]
        )


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows (SCHEMA), each bucket below n in a task of its own."""
    return rows.repartitionById(n, "bucket")


def whole(batches, kind) -> tuple[np.ndarray, np.ndarray]:
    """All records and words of a task."""
    records, words = [np.zeros(0, kind)], [np.zeros(0, np.uint64)]
    for batch in batches:
        records.append(joined(batch.column(1), kind))
        words.append(joined(batch.column(2), np.uint64))
    return np.concatenate(records), np.concatenate(words)


def stored(records: np.ndarray, words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Records and their words in rows (records, words) of about ROW bytes, for a table."""
    step, ends = max(1, ROW // records.itemsize), np.concatenate([[0], np.cumsum(counts)])
    for at in range(0, len(records), step):
        end = min(len(records), at + step)
        yield pa.RecordBatch.from_arrays([binary(records[at:end], [end - at]), binary(words[ends[at] : ends[end]], [ends[end] - ends[at]])], ["records", "words"])


def count_rows(seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts of cells, for `totals`."""
    cells = np.flatnonzero(seen)
    out = Outbox()
    records = np.zeros(len(cells), COUNT)
    records["cell"], records["n"] = cells, seen[cells]
    out.add(cells * PARTS // len(seen), records)
    yield from out.rows(True)


def totals(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of the tasks' counts in `size` cells, a fixed number; counts stop at 2^32 - 1."""

    def run(batches):
        counts, _ = whole(batches, COUNT)
        if len(counts):
            base = int(counts["cell"].min())
            seen = np.bincount(counts["cell"].astype(np.int64) - base, counts["n"]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), binary(np.minimum(seen, 0xFFFFFFFF).astype("<u4"), [len(seen)])], ["base", "seen"])

    out = np.zeros(size, np.int64)
    table = dealt(rows, PARTS).mapInArrow(arrays.tidied(run), "base long, seen binary").toArrow()
    for base, seen in zip(table["base"].to_pylist(), table["seen"].to_pylist(), strict=True):
        out[base : base + len(seen) // 4] += np.frombuffer(seen, "<u4")
    return out
