"""Words: runs of letters and digits, in lower case."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of ``text`` in order."""
    return WORD.findall(text.lower())


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgotten as a whole when the memory grows too large."""

    MOST = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1
        return value

    def of(self, found: list[str]) -> np.ndarray:
        """The hashes of a list of words."""
        return np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
