"""Words and word shingles of texts as numpy arrays, inside Python workers.

``bytes`` methods do what the word contract says: ``lower`` changes A-Z only and
``split`` splits at the six ASCII white-space characters only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: Odd 64-bit factors of a shingle's words; fixed values.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


#: How to empty the caches that each operator keeps in a worker between its tasks.
CACHES: dict[str, Callable[[], None]] = {}


def claim(owner: str) -> None:
    """Called as an operator's task starts: the caches of all others are emptied.

    A worker serves one operator after another, and together their caches would
    be several times what one needs.
    """
    for name, empty in CACHES.items():
        if name != owner:
            empty()


class WordHashes(dict):
    """64-bit hashes of words; emptied when full, which bounds its memory."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()
CACHES["words"] = HASHES.clear


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A-Z lower-cased.

    Fewer words than ``width`` are one shingle; no words are none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], np.uint64)
    h = HASHES.of(words)
    n = len(h) - width + 1
    s = h[:n] * np.uint64(FACTORS[0])
    for k in range(1, width):
        s += h[k : k + n] * np.uint64(FACTORS[k])
    return np.unique(mix(s))
