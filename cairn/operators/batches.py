"""Parts of Arrow batches whose texts a Python function holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts, unless one text has more, and rows of a part.
TEXT_BYTES, ROWS = 1 << 21, 1000


def parts(batches: Iterator[pa.RecordBatch], text: str | int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in their order, without copies."""
    for batch in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            full = np.searchsorted(end, (end[at - 1] if at else 0) + TEXT_BYTES, side="right")
            to = min(max(int(full), at + 1), at + ROWS)
            yield batch.slice(at, to - at)
            at = to
