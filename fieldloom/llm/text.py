"""Words, shingles and character hashes of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import regex
import xxhash

WORD = regex.compile(r"[\p{L}\p{N}_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[str]:
    """Matches of WORD in the lower-cased text; a null or empty text has none."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, kept for the words seen last."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        acc = mix(acc + hashes[i : len(hashes) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(acc)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of `width` code points, by doubling."""
    if len(points) < width:
        return np.zeros(0, np.uint64)
    power, size = mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    out, at = None, 0
    while True:
        if width & size:
            n = len(points) - (at + size) + 1
            part = power[at : at + n]
            out = part if out is None else mix(out[:n] * np.uint64(0xD6E8FEB86659FD93) + part)
            at += size
        if at == width:
            return out
        power = mix(power[:-size] * np.uint64(0xD6E8FEB86659FD93) + power[size:])
        size *= 2
