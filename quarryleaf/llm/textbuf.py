"""Vectorised hashing of words, straight from the bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarryleaf.llm.common import offsets_of

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_NOT_ALNUM = np.zeros(256, dtype=bool)
_NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES, PUNCT = _SPACE, _NOT_ALNUM
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("up")
    if have is None or len(have) < n:
        size = max(n, _PIECE + 1)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("up", _P), ("down", inverse)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and the offsets of rows in them."""
    off = offsets_of(text)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if text.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows; a row's end also ends a word."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~is_sep[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by differences of a prefix polynomial; worked in pieces of about 256 KiB."""
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        base = starts[k]
        stop = int(np.searchsorted(ends, base + _PIECE, side="right"))
        stop = max(stop, k + 1)
        piece = data[base : ends[stop - 1]]
        up, down = _powers(len(piece) + 1)
        prefix = np.empty(len(piece) + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=prefix[1:])
        a, b = starts[k:stop] - base, ends[k:stop] - base
        out[k:stop] = mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64) * _Q)
        k = stop
    return out


def words(text: pa.Array, is_sep: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, in order, and the offset of each row's first word (one more than rows)."""
    data, off = raw_bytes(text)
    if lower:
        data = LOWER[data]
    starts, ends = spans(data, off, is_sep)
    return hash_spans(data, starts, ends), np.searchsorted(starts, off, side="left")


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, row by row (a shorter row: its whole sequence as one), and the rows' offsets."""
    n = np.diff(off)
    full = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k):
        full = full * _Q + h[j : j + len(full)]
    full = mix(full + np.uint64(k))
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_off = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(out_off[-1], dtype=np.uint64)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(out)) - out_off[row] + off[row]
    long = n[row] >= k
    out[long] = full[at[long]]
    for r in np.flatnonzero((n > 0) & (n < k)):
        acc = np.zeros(1, dtype=np.uint64)
        for j in range(off[r], off[r + 1]):
            acc = acc * _Q + h[j]
        out[out_off[r]] = mix(acc + np.uint64(n[r]))[0]
    return out, out_off


def distinct_sets(s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the rows' offsets."""
    out = s.copy()
    for a, b in zip(off[:-1], off[1:], strict=True):
        out[a:b].sort()
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[keep], np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(off) - 1))))


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the values between offsets (0 where a row has none)."""
    total = np.concatenate((np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[off[1:]] - total[off[:-1]]
