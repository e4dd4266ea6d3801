"""Word shingles as sorted arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
MEMO_WORDS = 400_000


class WordHashes(dict):
    """64-bit hash of each word, remembered for the words of the task (a bounded number)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX
    values = (values ^ (values >> np.uint64(29))) * MIX
    return values ^ (values >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        out = out * MIX + hashes[i : i + n] + np.uint64(1)
    return mixed(out)


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; fewer words than `width` make one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < width:
        return windows(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(windows(hashes, width))
