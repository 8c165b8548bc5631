"""Vectorised helpers over Arrow text columns: slices of bytes, word spans and 64-bit word hashes.

Everything here works on one bounded slice of a batch, so memory follows the slice (or one long text), not the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space: every byte but 09-0D and 20.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words of letters, digits and bytes past ASCII, for text in lower case.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
#: Odd multipliers that tell the places of a gram apart.
ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in glibc only
#: Bytes that are hashed at once.
_BLOCK = 1 << 16
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, in place."""
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(by)
    h ^= h >> np.uint64(33)
    return h


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse within one block; further ones are products of two."""
    if not _powers:
        for name, base in (("up", _R), ("down", pow(_R, -1, 2**64))):
            steps = np.full(_BLOCK, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with at most limit bytes of text (or one row): rows, bytes, offsets."""
    if not batch.num_rows:
        return
    buf, off = raw(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that idles between tasks then holds no more than it needs."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of words before it (with the total at the end)."""
    w = is_word[buf]
    first, last = w.copy(), w.copy()
    if len(w):
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        rows = off[:-1][off[:-1] < off[1:]]
        first[rows] = w[rows]
        ends = off[1:][off[:-1] < off[1:]] - 1
        last[ends] = w[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands."""
    up, down = _tables()
    total = np.zeros(len(buf) + 1, np.uint64)
    for lo in range(0, len(buf), _BLOCK):
        part = _VALUE[buf[lo : lo + _BLOCK]]
        part *= up[: len(part)]
        part *= np.uint64(pow(_R, lo, 2**64))
        here = total[lo + 1 : lo + 1 + _BLOCK]
        np.cumsum(part, out=here)
        here += total[lo]
    h = total[ends]
    h -= total[starts]
    h *= down[starts % _BLOCK]
    if len(buf) >= _BLOCK:
        h *= np.array([pow(_R, -lo, 2**64) for lo in range(0, len(buf) + 1, _BLOCK)], np.uint64)[starts // _BLOCK]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions too near the end are left out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h += words[k : k + m] * ODD[k]
    return mix(h)


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
