"""Words of whole texts as 64-bit hashes, and rolling hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from plexweave.llm.common import worker_cache

#: Words that a worker remembers for each seed; beyond that it starts anew.
CACHE_WORDS = 120_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hash by word, for one seed."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_caches: dict[int, WordHashes] = worker_cache("words")


def hashes(seed: int = 0) -> WordHashes:
    """The worker's own cache for a seed."""
    return _caches.setdefault(seed, WordHashes(seed))


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; `lower` changes A-Z only. None for null."""
    if not text:
        return []
    data = text.encode()
    return (data.lower() if lower else data).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


#: Powers of an odd number and of its inverse, for hashes of words by differences of sums over a stretch of so many bytes.
_STRETCH = 1 << 17
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_STRETCH, 0xD6E8FEB86659FD93, np.uint64)])
_INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(_STRETCH, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)])


def line_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, start, end of each word of a line in which single blanks or line feeds stand between words.

    A word's hash is a polynomial of its bytes, taken for all words at once as differences of running sums.
    """
    raw = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(raw)]
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        base = starts[first]
        last = int(np.searchsorted(ends, base + _STRETCH, "right"))
        if last == first:  # a word beyond the stretch
            out[first] = xxhash.xxh3_64_intdigest(line[starts[first] : ends[first]])
            first += 1
            continue
        piece = raw[base : ends[last - 1]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(piece)], out=sums[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mixed((sums[b] - sums[a]) * _INVERSES[a] + (b - a).astype(np.uint64) * _STEP)
        first = last
    return out, starts, ends


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of `n` words; none for a shorter sequence."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = words[:size].copy()
    for j in range(1, n):
        out *= _STEP
        out += words[j : j + size]
    return mixed(out)
