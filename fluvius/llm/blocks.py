"""Texts in blocks of bounded size, each with its own dictionary of distinct units.

A corpus-wide figure of a unit (a word, a pair of tokens) is then asked for once a block and
distinct unit, not once an occurrence: what is shuffled grows with the blocks' dictionaries.
Blocks are written before they are used, so a lost task changes none of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20


def in_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(block, rows): consecutive rows of a task with about ``limit`` bytes in ``column``; blocks are numbered over all tasks."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    held, size, n = [], 0, 0
    for batch in batches:
        at, lengths = 0, np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: len(batch) + 1]) if len(batch) else []
        for k, b in enumerate(lengths):
            size += int(b)
            if size >= limit:
                held.append(batch.slice(at, k + 1 - at))
                yield first + n, pa.Table.from_batches(held)
                held, size, n, at = [], 0, n + 1, k + 1
        if at < len(batch):
            held.append(batch.slice(at))
    if held:
        yield first + n, pa.Table.from_batches(held)


class Codes:
    """Numbers of units in the order of their first use."""

    def __init__(self):
        self.of: dict = defaultdict()
        self.of.default_factory = self.of.__len__

    def __len__(self):
        return len(self.of)

    def get(self, units: list) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, units), np.int32, len(units))


def pack(codes: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob, 1 << 40) if blob else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
