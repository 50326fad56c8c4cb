"""Groups out of a sorted stream of Arrow batches, for mapInArrow after repartition and sortWithinPartitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces_by_key(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(is it a new key, rows) for runs of rows with equal values in the first columns.

    A run never crosses a batch, so a key's rows may come in several runs; only the first of them is new.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for i in range(n_keys):
            column = batch.column(i)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
        key = tuple(batch.column(i)[0].as_py() for i in range(n_keys))
        new[0] = key != last
        cuts = np.union1d(np.flatnonzero(new), [0, batch.num_rows])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield bool(new[a]), batch.slice(a, b - a)
        last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(n_keys))


def groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """All rows of each key. For keys whose groups are bounded by construction."""
    held: list[pa.RecordBatch] = []
    for new, rows in pieces_by_key(batches, n_keys):
        if new and held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(rows)
    if held:
        yield pa.Table.from_batches(held)
