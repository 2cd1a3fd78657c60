"""Vectorised text primitives over Arrow string columns (numpy, no per-row Python).

Texts are handled as UTF-8 bytes. Every separator used here is an ASCII byte, so a
byte-wise split never cuts a code point. Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

#: bytes of text handled at once; bounds a Python worker's memory whatever the batch size
SLICE_BYTES = 2 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_S33 = np.uint64(33)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: everything in ASCII but letters and digits
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Give freed memory back to the system: Python workers are kept and reused, and what
    one has ever held would otherwise count against its executor to the end."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (murmur style)."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes followed by eight zeros, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(8, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = np.zeros(at[-1] - at[0] + 8, np.uint8)
    data[: at[-1] - at[0]] = whole[at[0] : at[-1]]
    return data, at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text"):
    """Cut a batch so that each piece holds about SLICE_BYTES of text (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.zeros(len(column), np.int64)
    if len(column):
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(column):
        yield batch.slice(start)
    release()


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITESPACE):
    """(starts, ends, bounds): byte spans of all words, and each text's range among them."""
    n = int(offsets[-1])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    apart = separators[data[:n]]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = apart[:-1]
    edge = offsets[offsets < n]
    before[edge] = True
    starts = np.flatnonzero(before & ~apart)
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = apart[1:]
    after[edge[edge > 0] - 1] = True
    ends = np.flatnonzero(after & ~apart) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step. data must end in eight spare bytes."""
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _STEP + np.uint64(seed)
    live, at = None, 0
    longest = int(size.max()) if len(size) else 0
    while at < longest:
        if live is None:
            rest = np.minimum(size - at, 8)
            h = mix(h ^ (eight[starts + at] & _TAIL[rest]))
        else:
            rest = np.minimum(size[live] - at, 8)
            h[live] = mix(h[live] ^ (eight[starts[live] + at] & _TAIL[rest]))
        at += 8
        live = np.flatnonzero(size > at) if live is None else live[size[live] > at]
    return h


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries; entry i covers i .. i+n-1 (callers mask text ends)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _ROLL
        out += hashes[k : k + m]
    return mix(out)


def window_starts(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, text index) of each window of n words that lies within one text."""
    size = np.diff(bounds)
    count = np.maximum(size - n + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    return bounds[owner] + np.arange(len(owner)) - first[owner], owner


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each text's range (empty ranges: 0)."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
