"""Word, shingle and MinHash arithmetic on whole texts, vectorised in numpy.

Words are the runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A shingle is five words in a row; a text of one to four words has one shingle,
its whole sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
SEED = 20240607

_rng = np.random.default_rng(SEED)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A"):ord("Z") + 1] = _VALUE[ord("a"):ord("z") + 1]
_VALUE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.uint64(0xD6E8FEB86659FD93)
NO_SHINGLES = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(_BASE, 4096)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, in text order: a polynomial over the bytes of
    the word, summed for all words at once."""
    if not text:
        return NO_SHINGLES
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts = edge[::2]
    if not len(starts):
        return NO_SHINGLES
    at = np.arange(starts[0], len(data))
    at -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    longest = int(at.max()) + 1
    power = _POWERS if longest <= len(_POWERS) else powers(_BASE, longest)
    return mix(np.add.reduceat(_VALUE[data[starts[0]:]] * power[at], starts - starts[0]))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """One 64-bit hash per shingle, in text order, repeats included."""
    n = len(words)
    if not n:
        return NO_SHINGLES
    width = min(size, n)
    out = words[:n - width + 1].copy()
    for j, q in enumerate(powers(_ORDER, width)[1:], 1):
        out += words[j:n - width + 1 + j] * q
    return mix(out + np.uint64(width))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text)))


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large):
        return 0, 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both, len(a) + len(b) - both


class MinHash:
    """``k`` universal hash permutations x -> a*x + b (mod 2^32, a odd) of the
    upper half of each shingle hash; a signature holds the minimum of each."""

    def __init__(self, k: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.k = k
        self.a = (rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """All permutations of all shingles: a k x n array."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
        out = self.a * x
        out += self.b
        return out

    def signature(self, shingles: np.ndarray, block: int = 1024) -> np.ndarray:
        """k minima; all 2^32-1 for an empty set."""
        out = np.full(self.k, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(shingles), block):
            np.minimum(out, self.values(shingles[at:at + block]).min(axis=1), out=out)
        return out
