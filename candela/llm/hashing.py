"""Vectorised 64-bit hashing of words, shingles and byte windows."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for at, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base & (2**64 - 1), np.uint64)
            p[0] = 1
            _powers[at] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: any stretch's hash follows from two of them."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=out[1:])
    return out


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's UTF-8 bytes, A-Z lower-cased, and where its words start and end; words are runs of anything but ASCII white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words, in order."""
    return stretch_hashes(*word_places(text))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted set of hashed word shingles; a shorter text counts as one shingle, an empty one has none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = len(words)
    if not n:
        return words
    size = min(n, width)
    h = mix(words[: n - size + 1] + U64(size))
    for k in range(1, size):
        h = mix(h * U64(0xD6E8FEB86659FD93) + words[k : n - size + 1 + k])
    return np.unique(h)
