"""Words, shingles and their hashes over whole Arrow text columns; NumPy only, no loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd multipliers of the hash functions.
_P, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_PLACE = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for bytes of a word: all but ASCII white space; and: digits, ASCII letters and all that is not ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
#: bytes.translate tables: lower case A-Z, and all that is not in an ALNUM word a blank.
WORDS_TABLE = bytes(int(LOWER[i]) if ALNUM[i] else 32 for i in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(_M1)
    x = (x ^ (x >> _U(27))) * _U(_M2)
    return x ^ (x >> _U(31))


class _Powers:
    """_P**i and its inverse, as long as the longest piece of text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_P, _PINV))
        return self.up, self.down


_powers = _Powers()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each row's offsets in them; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole[:0], at - at[0]


def pieces(batch: pa.RecordBatch, column: int, most: int = 1_000_000, most_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text and ``most_rows`` rows each; a longer row stands alone."""
    if not batch.num_rows:
        return
    _, at = raw(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + most_rows, max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def spans(data: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words in each row) of all words; no word crosses rows."""
    inside = word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, at))


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's distinct shingles of ``width`` white-space words, A-Z lower-cased, sorted within
    the row, and how many each row has. Fewer words are one shingle; no word, none."""
    data, at = raw(column)
    data = LOWER[data]
    start, end, n = spans(data, at, NOT_SPACE)
    up, down = _powers.upto(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    words = mix((total[end] - total[start]) * down[start])
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    first = np.cumsum(n) - n
    own = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    base, left = np.repeat(first, count) + own, np.repeat(n, count) - own
    h = np.zeros(len(base), dtype=np.uint64)
    for j in range(width):
        ok = left > j
        h[ok] += words[base[ok] + j] * _PLACE[j] if not ok.all() else words[base + j] * _PLACE[j]
    h = mix(h + np.minimum(left, width).astype(np.uint64) * _PLACE[width])
    stop = np.cumsum(count)
    for lo, hi in zip((stop - count).tolist(), stop.tolist(), strict=True):
        h[lo:hi].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[(stop - count)[count > 0]] = True
    row = np.repeat(np.arange(len(n)), count)[new]
    return h[new], np.bincount(row, minlength=len(n)).astype(np.int64)


def set_ids(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit signatures of each row's set of hashes."""
    stop = np.cumsum(n)
    out = []
    for salt in (0x1234567, 0x89ABCDEF):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _U(salt)), dtype=np.uint64)])
        out.append(mix((s[stop] - s[stop - n]) + n.astype(np.uint64) * _U(_P)).view(np.int64))
    return out[0], out[1]
