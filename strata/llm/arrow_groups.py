"""Groups of consecutive rows in a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Slices of rows with equal keys; rows of a key must follow each other.

    Several runs of a batch come as slices without copies; only a run that goes on in the next
    batch is held over.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = table.slice(start, end - start)
            if start == 0 and held:
                if all(held[0].column(k)[0] == part.column(k)[0] for k in keys):
                    held.append(part)
                    continue
            if held:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pa.concat_tables(held) if len(held) > 1 else held[0]
