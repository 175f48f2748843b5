"""Hashes of words and byte windows over whole batches of texts, without a Python loop over words or bytes.

A polynomial hash modulo 2**64 of any span follows from running sums, so all words, or all windows of a length, are hashed at once.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed in one go: bounds the running sums for texts of any length.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to 0, 1, ..., n and its inverses."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def running(buf: np.ndarray) -> np.ndarray:
    """Running sums whose differences, times the inverse power of the start, are the hashes of spans."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: the runs between space, tab, line feed, vertical tab, form feed and carriage return."""
    gap = np.ones(len(buf) + 2, np.int8)
    gap[1:-1] = _SPACE[buf]
    edge = np.diff(gap)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, taken in pieces of about PIECE bytes (more only if a single word is longer)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        part = buf[base : int(ends[j - 1])]
        sums = running(part)
        s, t = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[t] - sums[s]) * powers(len(part))[1][s] + (t - s).astype(np.uint64))
        i = j
    return out


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` bytes (none if the text is shorter), before mixing; taken in pieces."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, PIECE):
        part = buf[at : at + PIECE + width - 1]
        sums = running(part)
        k = len(part) - width + 1
        out[at : at + k] = (sums[width : width + k] - sums[:k]) * powers(len(part))[1][:k]
    return out


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of texts with a line feed after each, and where each begins (one more entry: the end)."""
    parts = [t or b"" for t in texts]
    ends = np.cumsum([len(t) + 1 for t in parts], dtype=np.int64)
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), np.concatenate(([0], ends))


def batches_of(sizes: list[int], limit: int) -> list[slice]:
    """Cut a list into runs of at most ``limit`` in all (a single larger entry is a run of its own)."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            out.append(slice(at, i))
            at, total = i, 0
        total += n
    if at < len(sizes):
        out.append(slice(at, len(sizes)))
    return out
