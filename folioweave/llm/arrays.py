"""Arrow text as numpy arrays, and back, without per-row string calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets into them; null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and the row offsets into them."""
    raw, off = text_bytes(arr)
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, off
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return cps, before[off]


def strings(cps: np.ndarray, off: np.ndarray) -> pa.Array:
    """The inverse of code_points."""
    data = np.ascontiguousarray(cps, np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    if len(raw) == len(cps):
        at = off
    else:
        starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        at = starts[off]
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about most_bytes of text each; a longer row stands alone."""
    arr = batch.column(column)
    if len(arr) == 0:
        return
    _, off = text_bytes(arr)
    at = 0
    while at < len(arr):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def repeat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + count)."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)
