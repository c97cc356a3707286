"""Vectorised hashes of words and word shingles of many texts at a time (numpy, inside tasks).

A word is a maximal run of bytes other than space and tab to carriage return (0x20, 0x09-0x0D) of the UTF-8 text,
with A-Z lower-cased.  Its hash is a polynomial in a fixed odd base over 64 bits, finished by a mixing step.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.RandomState(20240229)
_VALUE = _random.randint(0, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (_random.randint(0, 2**63 - 1, 64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_LONGEST = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base % 2**64))
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces_of(data: np.ndarray, longest: int = _LONGEST) -> list[tuple[int, int]]:
    """Spans of at most about ``longest`` bytes that end at a space, so that no word is cut."""
    out, start = [], 0
    while len(data) - start > longest:
        cut = start + longest
        back = np.flatnonzero(_SPACES[data[start:cut]])
        if len(back):
            cut = start + int(back[-1]) + 1
        else:  # one word longer than the span: go on to its end
            ahead = np.flatnonzero(_SPACES[data[cut:]])
            cut = cut + int(ahead[0]) + 1 if len(ahead) else len(data)
        out.append((start, cut))
        start = cut
    return [*out, (start, len(data))]


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(data) + 1
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        _powers["up"], _powers["down"] = _power(_BASE, size), _power(pow(_BASE, -1, 2**64), size)
    total = np.empty(n, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[data] * _powers["up"][: n - 1], out=total[1:])
    return mixed((total[end] - total[start]) * _powers["down"][start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin (one more entry for the end)."""
    joined = b" ".join(texts)
    data = _LOWER[np.frombuffer(joined, np.uint8)]
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(length + 1, out=edge[1:])
    found, at = [], []
    for a, b in pieces_of(data) if len(data) else []:
        start, end = runs(~_SPACES[data[a:b]])
        found.append(span_hashes(data[a:b], start, end))
        at.append(start + a)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(at), edge)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out += words[i : i + n] * _STEP[i]
    return mixed(out)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words, but at least one, has its whole sequence as its one shingle; one without words has none.
    """
    words, first = words_of(texts)
    every = windows(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            whole = (words[a:b] * _STEP[size : size + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches_by_bytes(texts: list[bytes], most: int = _LONGEST) -> list[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``most`` bytes together."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            out.append((start, i))
            start, held = i, 0
        held += len(t) + 1
    return [*out, (start, len(texts))] if len(texts) > start else out
