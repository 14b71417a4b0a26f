"""Vectorised words and word n-grams of a batch of texts.

A word is ``[^\\x20\\x09-\\x0D]+``; A-Z are lower-cased, nothing else is
folded.  Words become 64-bit integers: a polynomial over the UTF-8 bytes whose
coefficients come from a random table, passed through a bijective mixer.  Whole
batches are hashed with a few NumPy passes, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_CHUNK = 1 << 20  # bytes hashed at once; longer texts are hashed alone


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers with good avalanche."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _CHUNK + 16)
            up = np.full(size, _BASE, dtype=np.uint64)
            down = np.full(size, _U(_inverse(int(_BASE))), dtype=np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if n > _CHUNK + 16:
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


def _hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a byte string."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    up, down = _Powers.of(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[_LOWER[raw]] * up[: len(raw)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return starts, mix64(value ^ ((ends - starts).astype(np.uint64) << _U(56)))


def words_of(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first text, offsets, hashes): text first+i has hashes[offsets[i]:offsets[i+1]].

    Each piece holds about a megabyte of text, so memory does not follow the
    size of the batch.  Null and empty texts have no words.
    """
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if parts and size + len(data) > _CHUNK:
            yield _piece(first, parts)
            first, parts, size = i, [], 0
        parts.append(data)
        size += len(data) + 1
    if parts:
        yield _piece(first, parts)


def _piece(first: int, parts: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    starts, hashes = _hash_bytes(b"\n".join(parts))
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    return first, np.searchsorted(starts, begins), hashes


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter sequence counts as one; none without words."""
    if not len(words):
        return words
    if len(words) < n:
        return shingle_ids(words, len(words))
    return np.unique(shingle_ids(words, n))


def shingle_ids(words: np.ndarray, n: int) -> np.ndarray:
    """Ids of all windows of n words, in order (order of words matters)."""
    size = len(words) - n + 1
    out = np.full(size, _U(n), dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + words[k : k + size]
    return mix64(out)
