"""Rows in and out of Arrow batches, a few at a time, so that a task holds little beside the batch that it was given."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that are read at once, and the most rows and characters that are handed on at once (one row more than that, if it is longer).
READ, ROWS, CHARS = 64, 8192, 1 << 21


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as tuples."""
    for lo in range(0, batch.num_rows, READ):
        yield from zip(*(c.to_pylist() for c in batch.slice(lo, READ).columns), strict=True)


def packed(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each handed on as soon as it is full."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)

    part, chars = [], 0
    for row in rows:
        part.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str | list))
        if len(part) >= ROWS or chars >= CHARS:
            yield batch()
            part, chars = [], 0
    if part:
        yield batch()
