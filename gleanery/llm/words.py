"""Words of texts in the consistent form, as hashes, for operators that compare runs of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from gleanery.llm.textform import consistent_form

WORD = re.compile(r"[^\W_]+")
_LIMIT = 400_000


class WordHashes(dict):
    """word -> 64-bit hash; equal on every machine. Emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()
#: Odd multipliers, one per position in a run.
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (runs of letters or digits) of a text that is already in the consistent form."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; fewer words are one run; no word, no run."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        out = np.uint64(n)
        for w in words:
            out = mix(np.array([out * _MULT[4] + w], dtype=np.uint64))[0]
        return np.array([out], dtype=np.uint64)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * _MULT[4] + (words[k : n - size + 1 + k] ^ _MULT[k % 4])
    return mix(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct run hashes of a stored text; null and texts without a word have none."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.unique(run_hashes(word_hashes(consistent_form(text)), size))
