"""Walk the sorted record batches of one task group by group, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def change_flags(*columns: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """True where a row differs from the one before it in any column; True for row 0.

    Nulls are equal to nulls and differ from every value.
    """
    n = len(columns[0])
    flags = np.zeros(n, dtype=bool)
    if n:
        flags[0] = True
    for col in columns:
        arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks)
        codes = arr.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        flags[1:] |= codes[1:] != codes[:-1]
    return flags


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a group of equal ``keys``.

    The batches must arrive sorted by ``keys``. A group larger than ``rows`` comes
    as one table, so callers bound their groups (by block columns in the key).
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        last = int(np.flatnonzero(change_flags(*(whole.column(k) for k in keys)))[-1])
        if last:
            yield whole.slice(0, last)
            held, n = whole.slice(last).to_batches(), whole.num_rows - last
    if held:
        yield pa.Table.from_batches(held)
