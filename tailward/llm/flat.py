"""Arrow text columns seen as one flat byte array, for numpy work inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the offset where each begins and the last ends; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(at: np.ndarray, size: int = SLICE_BYTES, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most`` rows and about ``size`` bytes; a longer row is a run of its own."""
    rows = len(at) - 1
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, rows, first + most)
        yield first, last
        first = last


def row_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` from each start to its end; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[starts]
