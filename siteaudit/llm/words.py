"""Word splitting, word hashing and shingle hashing shared by the corpus operators.

These run inside Arrow batches. Words come from whole texts; a null text has no words.
"""

from __future__ import annotations

import numpy as np
import xxhash

SPACES = bytes(range(0x09, 0x0E)) + b" "
LETTERS = bytes(range(ord("A"), ord("Z") + 1))

# Bytes that end a word for the benchmark rule: everything in ASCII but letters and digits.
PLAIN = bytearray(range(256))
for _b in range(128):
    if not (0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A):
        PLAIN[_b] = 0x20
for _b in LETTERS:
    PLAIN[_b] = _b + 32
PLAIN = bytes(PLAIN)

LOWER = bytes(_b + 32 if _b in LETTERS else _b for _b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def space_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D, as UTF-8."""
    if not text:
        return []
    b = text.encode("utf-8", "surrogatepass")
    return (b.translate(LOWER) if lower else b).split()


class WordIds(dict):
    """word -> 64-bit hash; cleared when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that their order looks random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` words; a shorter text is one window."""
    if not len(ids):
        return ids
    size_here = min(size, len(ids))
    n = len(ids) - size_here + 1
    out = np.full(n, np.uint64(size_here), np.uint64)
    for k in range(size_here):
        out = out * _MULT + ids[k : k + n]
    return mixed(out)


def shingles(words: list[bytes], ids: WordIds, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(windows(ids.of(words), size))
