"""Word shingles as 64-bit hashes, and bottom-k sketches of them, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: The sketches' one hash function is the shingle's own 64-bit hash.
SKETCH = 48
_MAX_WORDS = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """word -> 64-bit hash; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: _Words, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles.

    Words are runs of other bytes than space and \\t to \\r, with A-Z in lower
    case. A text of fewer words than ``size`` is one shingle; without words,
    the set is empty.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    m = max(1, n - size + 1)
    acc = np.full(m, min(n, size), np.uint64)
    for j in range(min(n, size)):
        acc = _mixed(acc * _P + h[j : j + m])
    return np.unique(acc)
