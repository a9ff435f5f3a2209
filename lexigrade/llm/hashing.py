"""Vectorised words, word hashes and window hashes over Arrow text columns.

Everything works on the UTF-8 bytes of a whole column slice at once, so a
text of any length costs a constant number of NumPy passes and no Python
object per word.  All hashes are fixed functions of the bytes: the same text
gives the same hash on every executor and in every attempt of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _STEP = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
_LOW = [U64((1 << (8 * k)) - 1) for k in range(8)] + [U64(0xFFFFFFFFFFFFFFFF)]
_MASK = np.array(_LOW, dtype=U64)

#: Text bytes handled in one NumPy pass; bounds a worker's memory.
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h *= _M1
    h ^= h >> U64(29)
    h *= _M2
    h ^= h >> U64(32)
    return h


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` text bytes, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of each maximal run of non-space bytes within a row."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    solid = np.empty(n + 1, dtype=bool)
    np.logical_not(SPACE[data], out=solid[:n])
    solid[n] = False
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:] = solid[:-1] & (~solid[1:] | first[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end - start, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step; long words take more steps."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = length.astype(U64) * _STEP + U64(seed)
    rest = np.flatnonzero(length > 0)
    step = 0
    while len(rest):
        left = length[rest] - step
        chunk = at[start[rest] + step] & _MASK[np.minimum(left, 8)]
        h[rest] = mix((h[rest] ^ chunk) + _STEP)
        step += 8
        rest = rest[left > 8]
    return h


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of h[i:i+width] for every i that has a full window; rows aren't heeded."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(seed) + _STEP, dtype=U64)
    for k in range(width):
        out *= _M1
        out += h[k : k + n]
        out ^= out >> U64(31)
    return mix(out)


def full_windows(row: np.ndarray, width: int) -> np.ndarray:
    """Whether the window that begins at each word ends in the same row."""
    n = len(row) - width + 1
    return row[:n] == row[width - 1 :] if n > 0 else np.zeros(0, bool)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of the width that begins at one of starts."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(starts + width, n), -1)
    return np.cumsum(depth[:n]) > 0
