"""Streaming over rows that a sort has brought together, and small union-find, for Arrow functions.

Keys must not be null: callers give them a value first. No rows give no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 2) -> Iterator[pa.RecordBatch | pa.Table]:
    """Each run of equal ``keys`` (integers without nulls) of ``least`` rows or more, as one batch or table.

    Rows of one group may lie in several batches; only the group at a batch's end is held.
    """
    held: list[pa.RecordBatch] = []

    def joined() -> pa.Table | None:
        table = pa.Table.from_batches(held) if held else None
        held.clear()
        return table if table is not None and table.num_rows >= least else None

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        at = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and last != [c[0] for c in columns] and (done := joined()) is not None:
            yield done
        for a, b in zip(at[:-2], at[1:-1]):
            if a == 0 and held:
                held.append(batch.slice(a, b - a))
                if (done := joined()) is not None:
                    yield done
            elif b - a >= least:
                yield batch.slice(a, b - a)
        held.append(batch.slice(at[-2]))
        last = [c[-1] for c in columns]
    if (done := joined()) is not None:
        yield done


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of ``n`` items linked by pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
