"""Arrow batches that arrive sorted by a key, handed on group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that agree in the first `keys` columns (nulls agree). A group is held whole: callers bound its size."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            col = batch.column(c)
            a, b = col.slice(1), col.slice(0, len(col) - 1)
            differ = pc.invert(pc.equal(a, b)).fill_null(True)
            change[1:] |= pc.and_(differ, pc.invert(pc.and_(a.is_null(), b.is_null()))).to_numpy(zero_copy_only=False)
        first = tuple(batch.column(c)[0].as_py() for c in range(keys))
        change[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if (a > 0 or change[0]) and held:
                yield pa.concat_tables(held)
                held = []
            if b > a:
                held.append(table.slice(a, b - a))
        last = tuple(batch.column(c)[-1].as_py() for c in range(keys))
    if held:
        yield pa.concat_tables(held)
