"""Helpers for Arrow batches inside tasks: bounded pieces, byte views of text columns, code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step of vectorised work holds; a longer text makes a piece of its own.
PIECE_BYTES = 2 << 20
PIECE_ROWS = 1024

BLANKS = b" \t\n\r\x0b\x0c"


def pieces(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut batches into runs of rows with at most ``limit`` text bytes and ``rows`` rows, each with its texts as bytes; only one is copied at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        sizes = pc.binary_length(column).fill_null(0).to_pylist()
        start = held = 0

        def cut(end: int, start: int, batch=batch, column=column) -> tuple[pa.RecordBatch, list[bytes | None]]:
            return batch.slice(start, end - start), column.slice(start, end - start).cast(pa.large_binary()).to_pylist()

        for i, size in enumerate(sizes):
            if held and held + size > limit or i - start == rows:
                yield cut(i, start)
                start, held = i, 0
            held += size
        if start < len(sizes) or not sizes:
            yield cut(len(sizes), start)


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
