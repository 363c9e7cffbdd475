"""Vectorised text primitives over Arrow string columns: no Python object is made per word or character.

Everything works on the UTF-8 bytes of a slice of rows; a slice holds about a megabyte, or one longer document,
so memory is bounded by the longest document and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

# Words of the shingle contracts: [^\x20\x09-\x0D]+
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
# Letters and digits; every byte of a character beyond ASCII counts as one.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; NULL is empty."""
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def scramble(h: np.ndarray) -> np.ndarray:
    """In place: every input bit reaches every output bit."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of member bytes, and for each row the index of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = member[buf]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = BYTE_LOWER, limit: int = SLICE,
                prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hash of each span [s, e) of bytes; spans are in order and none is empty.

    With prefixes there is one more row for each: the hash of the span's first bytes."""
    out = np.empty((1 + len(prefixes), len(s)), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + limit, "right")))
        a, b = int(s[i]), int(e[i:j].max())
        up, down = powers(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[buf[a:b]] * up, out=total[1:])
        for k, most in enumerate((1 << 62, *prefixes)):
            out[k, i:j] = (total[np.minimum(e[i:j], s[i:j] + most) - a] - total[s[i:j] - a]) * down[s[i:j] - a]
        i = j
    scramble(out)
    return out if prefixes else out[0]


_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, sorted. Fewer words than the width are one shingle; none is empty."""
    places = _PLACES[:width]
    n = len(hashes) - width + 1
    if n > 0:
        whole = hashes[:n] * places[0]
        for k in range(1, width):
            whole += hashes[k:n + k] * places[k]
        scramble(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(whole[a:b - width + 1])
        elif b > a:
            short = (hashes[a:b] * places[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            yield scramble(short)
        else:
            yield np.zeros(0, np.uint64)
