"""Words of many texts at once, as byte ranges and 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = 0x9E6C63D0876A9A4B | 1


def _table(separators: list[int]) -> np.ndarray:
    """Byte -> lower-cased (A-Z) byte, 0 for separators."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[separators] = 0
    return t


#: Words are what white space (0x20, 0x09-0x0D) leaves; NUL is told apart from a separator by ``SPACED_BREAK``.
SPACED_BREAK = np.zeros(256, bool)
SPACED_BREAK[[0x20, *range(0x09, 0x0E)]] = True
#: Words of digits, letters and whatever is beyond ASCII.
ALNUM_BREAK = np.zeros(256, bool)
ALNUM_BREAK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = _table([])
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``; the process keeps the longest it has needed."""
    if not _tables or len(_tables[0]) < n:
        with np.errstate(over="ignore"):
            up = np.full(n, _P, np.uint64)
            down = np.full(n, pow(_P, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _tables[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _tables


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes, so that arrays over bytes stay small."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = min(n, max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1))
        yield start, stop
        start = stop


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (``np.unique`` hashes integers, which is many times slower here)."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def tokens(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all words."""
    found, texts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for lo, hi in slices(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, doc = split(part, own, breaks)
        found.append(hashes(part, starts, ends))
        texts.append(doc + lo)
    return np.concatenate(found), np.concatenate(texts)


def split(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text numbers) of the words; none spans two texts."""
    inside = ~breaks[data]
    if not len(inside):
        z = np.empty(0, np.int64)
        return z, z, z
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[heads[1:] - 1] = inside[heads[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased bytes: a polynomial over random byte codes, mixed with the length."""
    up, down = _powers(max(1 << 16, 1 << int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[LOWER[data]] * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
    return h
