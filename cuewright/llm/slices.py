"""Arrow batches in slices of bounded size, and text cut into words by Arrow functions: for kernels that hold a slice several times over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE_BYTES = 6_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches whose ``column`` (strings) holds at most ``most`` bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + (most or SLICE_BYTES), side="right")))
            yield batch.slice(at, to - at)
            at = to


def words_by_spaces(spaced: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts whose only separator is the space, as one array, and the row that each belongs to."""
    lists = pc.split_pattern(spaced, " ")
    words, rows = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), rows[some.to_numpy(zero_copy_only=False)]


def summed(tables: list[pa.Table], keys: list[str], values: list[str]) -> pa.Table:
    """Rows with equal ``keys`` become one, with the sums of their ``values``."""
    table = pa.concat_tables(tables)
    found = table.group_by(keys, use_threads=False).aggregate([(v, "sum") for v in values])
    return found.select([*keys, *[f"{v}_sum" for v in values]]).rename_columns([*keys, *values])


def summing(parts: Callable[[pa.RecordBatch], pa.Table], column: str, keys: list[str], values: list[str], most: int = 500_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel that sums what ``parts`` makes of each slice, and lets go of its rows at ``most`` of them."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back, which the default one keeps for itself
        held, rows = [], 0
        for batch in slices(batches, column):
            held.append(parts(batch))
            rows += held[-1].num_rows
            if rows >= most:
                held = [summed(held, keys, values)]
                rows = held[0].num_rows
                if rows >= most // 2:
                    yield from held[0].to_batches(100_000)
                    held, rows = [], 0
        if held:
            yield from summed(held, keys, values).to_batches(100_000)

    return kernel
