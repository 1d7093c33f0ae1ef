"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of a string column each, one row at least."""
    texts = batch.column(column)
    begin, size = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if i > begin and size + n > most:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += int(n)
    if len(lengths) > begin:
        yield batch.slice(begin)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables with the rows of one group each, from batches in the order of integer keys."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        cuts = _cuts(table, keys)
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield table.slice(a, b - a).combine_chunks()
        rest = table.slice(cuts[-2]) if len(cuts) > 1 else None
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _cuts(table: pa.Table, keys: list[str]) -> list[int]:
    """Row numbers where groups begin, and the end."""
    if not table.num_rows:
        return [0]
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return [*np.flatnonzero(change).tolist(), table.num_rows]
