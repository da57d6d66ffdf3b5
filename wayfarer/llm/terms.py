"""Words and their 64-bit hashes for many texts at once, straight from the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from wayfarer.llm.common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty), with 40 bytes of padding, and the offsets of its rows."""
    if not len(column):
        return np.zeros(40, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return np.concatenate([raw, np.zeros(40, np.uint8)]), offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are inside (a table of 256), cut at the texts' ends; and each text's number of runs."""
    n = int(offs[-1])
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    on = inside[buf[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin, end = on & edge[:n], on & edge[1:]
    begin[1:] |= on[1:] & ~on[:-1]
    end[:-1] |= on[:-1] & ~on[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs, "left"))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run. All bytes count: of runs over 24 bytes, the rest comes in by xxhash."""
    lens = ends - starts
    words = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    h = lens.astype(np.uint64) * _C[3]
    for k in range(3):
        at = np.minimum(starts + 8 * k, len(words) - 1)
        h = mix64(h ^ (words[at] & _MASK[np.clip(lens - 8 * k, 0, 8)]) * _C[k])
    long = np.flatnonzero(lens > 24)
    if len(long):
        h[long] = [xxhash.xxh3_64_intdigest(buf[s:e].tobytes()) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all rows, the number of each row's; then the bytes, starts and ends of words."""
    buf, offs = buffer_of(column)
    starts, ends, count = spans(buf, offs, ~_SPACE)
    if lower:
        buf = _LOWER[buf]
    return hashes(buf, starts, ends), count, buf, starts, ends


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms (runs of letters and digits; A-Z in lower case) of all rows, and the number of each row's."""
    buf, offs = buffer_of(column)
    starts, ends, count = spans(buf, offs, _TERM)
    return hashes(_LOWER[buf], starts, ends), count
