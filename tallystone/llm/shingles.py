"""Word shingles of whole texts as sorted arrays of 64-bit hashes, and their MinHash bands."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

from tallystone.llm.common import Memo

WORDS = 5
#: What parts two words (the same characters in Python, Spark and SQL patterns).
GAP = "[ \t\n\r\f]+"

_split = re.compile(GAP).split
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


@lru_cache(1)
def _word_hashes() -> Memo:
    import xxhash

    return Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))


@lru_cache(8)
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 62, n, dtype="u8") * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` lower-cased words; a text of fewer words, but not of none, is one shingle."""
    found = [w for w in _split(text.lower()) if w]
    if not found:
        return np.zeros(0, "u8")
    h = np.fromiter(map(_word_hashes().__getitem__, found), "u8", len(found))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, "u8")
        for i, factor in enumerate(_odd(words, 11)[:n]):
            total += h[i : len(h) - n + 1 + i] * factor
        return np.unique(mix(total))


def bands_for(similarity: float, recall: float, most: int = 224) -> tuple[int, int]:
    """(bands, rows): the most rows, and the fewest bands for them, by which a pair of that similarity meets in a band with that probability,
    within `most` hash functions."""
    best = None
    for rows in range(1, 65):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(similarity**rows)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("more hash functions are needed for this recall")
    return best


def band_hashes(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band, over the least values of its rows; the band's number is part of it."""
    factors, added = _odd(bands * rows, 12), _odd(bands * rows, 13)
    with np.errstate(over="ignore"):
        least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(found), 1024):
            np.minimum(least, (found[at : at + 1024, None] * factors + added).min(0), out=least)
        weighed = mix(least.reshape(bands, rows) + np.arange(bands, dtype="u8")[:, None]) * _odd(rows, 14)
        return mix(weighed.sum(1, dtype="u8")).view("i8")
