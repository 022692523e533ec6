"""Polynomial prefix hashes of bytes, and what is built on them.

With P[i] = sum of byte[j] * B**j for j < i, modulo 2**64, the hash of bytes s to e is
(P[e] - P[s]) * B**-s, one subtraction and one product for any stretch. B is odd, so it has
an inverse. Hashes are mixed before they are compared or used as keys.
"""

import numpy as np

BASE = 0x9E6C63D0676A9A99  # odd
INVERSE = pow(BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = _table(BASE, n)
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        _inverses = _table(INVERSE, n)
    return _inverses


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P[0..n] of a byte array."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def stretch_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the stretches, lengths included."""
    inverse = inverse_powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles (A-Z lower-cased, ASCII white space).

    A text of fewer words, but at least one, is one shingle.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    h = stretch_hashes(prefix_hashes(data), start, end)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k: len(h) - size + 1 + k])
    return np.unique(out)
