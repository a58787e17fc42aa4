"""Word shingles of blocks of texts, hashed with numpy on the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + _U((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, _U)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of the texts, and for each text the place of its first word (one more at the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    gap = _SPACE[buf]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(buf))
    total = np.concatenate(([_U(0)], np.cumsum((buf.astype(_U) + _U(1)) * power, dtype=_U)))
    words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return words, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct k-word shingles, in order of number and hash.

    A text of fewer than k words is one shingle; without words it has none.
    """
    words, first = word_hashes(texts)
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, 0)
    number = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    value = np.zeros(len(at), _U)
    for j in range(k):
        value = value * _U(0xFF51AFD7ED558CCD) + words[at + j]
    value = mix(value, 1)
    if len(short := np.flatnonzero((counts > 0) & (counts < k))):
        more = np.empty(len(short), _U)
        for i, d in enumerate(short):
            v = int(counts[d])
            for w in words[first[d] : first[d + 1]].tolist():
                v = (v * 0xFF51AFD7ED558CCD + w) % (1 << 64)
            more[i] = v
        number, value = np.concatenate((number, short)), np.concatenate((value, mix(more, 2)))
    order = np.lexsort((value, number))
    number, value = number[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (number[1:] != number[:-1]) | (value[1:] != value[:-1])
    return number[keep], value[keep]


def blocks(texts: list[str | None], limit: int = 1 << 20):
    """(start, end) of runs of texts of about limit characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
