"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct ``width``-word shingles, ascending.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A
    text of fewer words is one shingle, one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(width, len(words))
    rows = len(words) - take + 1
    out = np.full(rows, take, np.uint64)
    for k in range(take):
        out = _mix(out * _A + h[k : k + rows])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit number for a whole set."""
    v = xxhash.xxh3_64_intdigest(s.tobytes())
    return v - (1 << 64) if v >> 63 else v
