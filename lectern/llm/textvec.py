"""Word and shingle hashes of many texts at a time, straight from Arrow's UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MUL, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=U)
#: Bytes of text that are worked on at a time; a longer text is a batch of its own.
CHUNK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but the white space 0x20, 0x09-0x0D belongs to a word.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False
#: Letters, digits and whatever is not ASCII belong to a word.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, m in enumerate((_MUL, _INV)):
            x = np.full(max(n, CHUNK * 2), m, dtype=U)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U)
        if n > CHUNK * 8:
            out = _powers[0], _powers[1]
            _powers[:] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]
            return out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows of about `most` bytes; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, min(int(np.searchsorted(offs, offs[lo] + most, "right")) - 1, lo + 65536))
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, belongs: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its start, its end, number of words before each text and in all). A-Z count as a-z."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, U), none, none, np.zeros(len(offs), np.int64)
    inside = belongs[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, inv = powers(n + 1)
    total = np.empty(n + 1, dtype=U)
    total[0] = 0
    np.cumsum(_TABLE[LOWER[data]] * p[:n], out=total[1:])
    raw = (total[e] - total[s]) * inv[s]
    return mix(raw ^ ((e - s).astype(U) * U(0xD6E8FEB86659FD93))), s, e, np.searchsorted(s, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct k-word shingles of text i are hashes[bounds[i]:bounds[i + 1]], sorted.

    A text of fewer words has its whole sequence as its one shingle, a text without words has none.
    """
    h, _, _, at = words(data, offs)
    parts, sizes = [], np.zeros(len(offs), dtype=np.int64)
    if len(h) >= k:
        joined = np.zeros(len(h) - k + 1, dtype=U)
        for j in range(k):
            joined = joined * U(0xA24BAED4963EE407) + h[j : len(h) - k + 1 + j]
        joined = mix(joined + U(k))
    for i in range(len(offs) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            own = joined[a : b - k + 1]
            own = np.sort(own)
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = np.zeros(1, dtype=U)
            for x in h[a:b]:
                own = own * U(0xA24BAED4963EE407) + x
            own = mix(own + U(b - a))
        else:
            continue
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.empty(0, U)), np.cumsum(sizes)
