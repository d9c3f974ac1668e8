"""Groups of rows in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]
                  ) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts (and the last one ends).
    Rows must come sorted by ``keys``; a group cut by a batch waits for its rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and all(held[0].column(k)[0] == batch.column(k)[-1] for k in keys):
            continue  # still inside one group
        table = pa.Table.from_batches(held).combine_chunks()
        edges = _edges(table, keys)
        if len(edges) > 2:
            yield table.slice(0, edges[-2]), edges[:-1]
        held = table.slice(edges[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _edges(table, keys)


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def binary_matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    """A column of equally long binaries as a matrix of ``kind`` (``width`` columns)."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(len(column), width)
