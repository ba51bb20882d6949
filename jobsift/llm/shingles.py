"""Words and word-shingle hashes of one text, vectorised with numpy inside tasks.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z, taken on
the UTF-8 bytes (``bytes.lower`` changes A-Z only). A word's hash is a 64-bit polynomial
over a random byte table, finished by a mixer; a shingle's hash combines its words'.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
SEGMENT = 1 << 22
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0xD6E8FEB86659FD93 | 5
_PINV = pow(_P, -1, 1 << 64)
_SHIFT = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.cumprod(steps)
    return have[:n]


def _hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * _power(_P, len(raw)))))
    return mix((total[end] - total[start]) * _power(_PINV, len(raw) + 1)[start])


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order (long texts go segment by segment)."""
    data = data.lower()
    if len(data) <= SEGMENT:
        return _hashes(data) if data else np.zeros(0, dtype=np.uint64)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        parts.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's ``width``-word shingles.

    A text with fewer words is one shingle, its whole sequence; none without words.
    """
    words = word_hashes(data or b"")
    if len(words) == 0:
        return words
    size = min(width, len(words))
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        total += words[i : len(words) - size + 1 + i] * _SHIFT[i]
    return np.unique(mix(total + _U(size)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct hash arrays."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
