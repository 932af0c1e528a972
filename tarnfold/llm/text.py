"""Words, shingle hashes and other text pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of anything but ASCII white space (0x20, 0x09-0x0D): bytes.split's own rule."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size``-word shingles; a shorter text is one shingle; none without words."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _A + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def each(column: pa.Array, rows: int = 256) -> Iterator:
    """A column's values as Python objects, a few rows at a time: a batch of texts isn't held twice."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()


def tidy() -> None:
    """Gives back what Arrow's pool keeps: workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
