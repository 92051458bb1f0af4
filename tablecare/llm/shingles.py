"""Word shingles as 64-bit hashes.

Words are the maximal runs without ASCII white space, A-Z lower-cased.  A
text's set holds the hashes of its distinct runs of ``k`` words; a text with
fewer words counts whole as one shingle, and one without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Words whose hashes a worker remembers; a full memory is emptied.
_REMEMBERED = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHashes()


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``k`` words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = w[:n].copy()
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * _A + w[i:n + i]
    return np.unique(mix(h))
