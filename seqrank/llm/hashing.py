"""Vectorised 64-bit hashes of the runs of characters in a UTF-8 text."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = [_powers(_BASE, (1 << 16) + 1), _powers(pow(_BASE, -1, 1 << 64), (1 << 16) + 1)]
#: Of each byte: 0 blank, 1 ASCII sign, 2 letter, digit or part of a longer character.
_KIND = np.array([0 if b == 32 or 9 <= b <= 13 else 2 if b >= 128 or chr(b).isalnum() or b == 95 else 1 for b in range(256)], np.int8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of other bytes than the six blanks begin and end."""
    edge = np.diff(np.concatenate([[False], _KIND[b] > 0, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def runs(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of letters and digits, and runs of signs, begin and end."""
    kind = np.concatenate([[0], _KIND[b], [0]]).astype(np.int8)
    change = np.flatnonzero(kind[1:] != kind[:-1])
    begin, end = change[:-1], change[1:]
    real = kind[begin + 1] > 0
    return begin[real], end[real]


#: Bytes that are hashed at once, whole spans of them: a table of powers is no longer than this, or than one span.
CHUNK = 1 << 16


def spans_hash(b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(begin) or end[-1] - begin[0] <= CHUNK or len(begin) == 1:
        return _hashed(b, begin, end)
    out, k = [], 0
    while k < len(begin):
        stop = max(k + 1, int(np.searchsorted(end, begin[k] + CHUNK, "right")))
        out.append(_hashed(b, begin[k:stop], end[k:stop]))
        k = stop
    return np.concatenate(out)


def _hashed(b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, U)
    first = begin[0]
    part = b[first : end[-1]]
    up, down = _TABLES if len(part) < CHUNK + 1 else [_powers(base, len(part) + 1) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    total = np.concatenate([np.zeros(1, U), np.cumsum((part.astype(U) + U(1)) * up[: len(part)])])
    return mixed((total[end - first] - total[begin - first]) * down[begin - first] + (end - begin).astype(U))
