"""Arrow batches in parts of bounded size, for maps in Python: a task's working memory follows
the part, not the rows that Spark puts into a batch."""

from __future__ import annotations

from collections.abc import Iterator


def release_memory() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A map over Arrow batches that gives its memory back when its task ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped


def parts(batch, *cols: int, size: int) -> Iterator:
    """Runs of rows whose columns ``cols`` hold about ``size`` list items or text bytes
    together; a longer single row is a run of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = np.zeros(batch.num_rows, np.int64)
    for c in cols:
        col = batch.column(c)
        n = pc.list_value_length(col) if pa.types.is_list(col.type) else pc.binary_length(col)
        held += np.asarray(pc.fill_null(n, 0)).astype(np.int64)
    upto, start = np.cumsum(held), 0
    while start < batch.num_rows:
        before = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
        yield batch.slice(start, end - start)
        start = end
