"""Hashed word shingles of whole texts, computed for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int, part: int = 1 << 18) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of bytes other than the six ASCII white-space bytes, A-Z in lower case. A text with fewer words than
    `width` has its whole sequence as one shingle; a text that is null or has no word has none.
    """
    data = [(t or "").encode() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(data):  # parts of about `part` bytes, or one text
        end, size = at, 0
        while end < len(data) and (end == at or size + len(data[end]) < part):
            size += len(data[end]) + 1
            end += 1
        out += _sets(data[at:end], width)
        at = end
    return out


def _sets(data: list[bytes], width: int) -> list[np.ndarray]:
    buf = _LOWER[np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)]
    starts_of = np.cumsum([1] + [len(d) + 1 for d in data])
    space = _SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _powers(len(buf))
    prefix = np.r_[np.uint64(0), np.cumsum(_BYTES[buf] * power)]
    word = mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64))
    bounds = np.searchsorted(start, starts_of)
    n = np.diff(bounds)
    full = max(len(word) - width + 1, 0)
    grams = word[:full].copy()
    for k in range(1, width):
        grams = mix(grams * _BASE + word[k : k + full])
    out = []
    for i, count in enumerate(n.tolist()):
        first = int(bounds[i])
        if count >= width:
            out.append(np.unique(grams[first : first + count - width + 1]))
        elif count:
            h = word[first : first + 1].copy()
            for k in range(1, count):
                h = mix(h * _BASE + word[first + k : first + k + 1])
            out.append(mix(h + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
