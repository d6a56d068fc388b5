"""Sorted whole numbers with counts, packed by gaps to a few bytes each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def sums(ordered: np.ndarray, ways: list[np.ndarray] | None) -> list[np.ndarray]:
    """The distinct values of a sorted array, and how often each comes; with ``ways`` instead the sums of each of these."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    if ways is None:
        return [ordered[starts], np.diff(starts, append=len(ordered))]
    return [ordered[starts], *(np.add.reduceat(w, starts) if len(starts) else w for w in ways)]


def summed(codes: np.ndarray, ways: list[np.ndarray] | None) -> list[np.ndarray]:
    """As :func:`sums`, of an array in any order. Without ``ways`` it is sorted in place.

    Numbers alone are sorted several times faster than their places, so counts are put behind their code's bits where all fit.
    """
    if ways is None:
        codes.sort()
        return sums(codes, None)
    if not len(codes):
        return [codes, *ways]
    least, bits = int(codes.min()), [int(w.max()).bit_length() for w in ways]
    if (int(codes.max()) - least).bit_length() + sum(bits) > 63:
        order = np.argsort(codes)
        return sums(codes[order], [w[order] for w in ways])
    both = codes - least
    for w, b in zip(ways, bits, strict=True):
        both <<= b
        both |= w
    both.sort()
    apart = []
    for b in reversed(bits):
        apart.insert(0, both & ((1 << b) - 1))
        both >>= b
    both += least
    return sums(both, apart)


def pack(codes: np.ndarray, *counts: np.ndarray) -> bytes:
    """Ascending numbers, one at least, and the columns beside them: bytes by significance, as far as any is in use, compressed."""
    planes, head = [], [len(codes), 1 + len(counts)]
    for column in (np.diff(codes, prepend=0), *counts):
        used = 8 if column.min() < 0 else max(1, (int(column.max()).bit_length() + 7) // 8)
        planes.append(np.ascontiguousarray(column.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :used].T).ravel())
        head.append(used)
    raw = np.concatenate(planes)
    return np.array([*head, *[0] * (8 - len(head))], "<i8").tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(block: pa.Buffer) -> list[np.ndarray]:
    """What :func:`pack` was given."""
    n, columns, *used = np.frombuffer(block, "<i8", 8).tolist()
    raw = np.frombuffer(pa.Codec("zstd").decompress(block.slice(64), sum(used[:columns]) * n), np.uint8)
    out, at = [], 0
    for k in used[:columns]:
        column = np.zeros((n, 8), np.uint8)
        column[:, :k] = raw[at : at + k * n].reshape(k, n).T
        out.append(column.view("<i8").ravel())
        at += k * n
    return [np.cumsum(out[0]), *out[1:]]
