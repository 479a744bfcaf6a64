"""Hashes of normalised words, and many texts in one array."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import xxhash

#: Characters of text handled at once; bounds the arrays of a batch.
CHUNK = 4 << 20
EDGES = b".,;:!?\"'()[]{}<>*"


class NormalHasher:
    """64-bit hashes of words, lower-cased and without punctuation at their ends; words known are hashed once.

    With ``marks_zero`` words of punctuation and symbols only, such as comment marks, are zero.
    """

    def __init__(self, marks_zero: bool = False) -> None:
        self.known: dict[bytes, int] = {}
        self.marks_zero = marks_zero

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode().split()
        known = self.known
        for word in set(words).difference(known):
            mark = self.marks_zero and all(unicodedata.category(c)[0] in "PS" for c in word.decode())
            known[word] = 0 if mark else xxhash.xxh64_intdigest(word.strip(EDGES) or word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def joined(texts: list[str | None], gap: int, marks_zero: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, word hashes, starts, ends) for groups of whole texts, ``gap`` zeros behind each text."""
    at = 0
    while at < len(texts):
        hasher, parts, starts, ends, filled, size, first = NormalHasher(marks_zero), [], [], [], 0, 0, at
        space = np.zeros(gap, np.uint64)
        while at < len(texts) and (at == first or size < CHUNK):
            size += len(texts[at] or "")
            words = hasher(texts[at])
            starts.append(filled)
            ends.append(filled + len(words))
            filled += len(words) + gap
            parts += [words, space]
            at += 1
        yield first, np.concatenate(parts), np.array(starts), np.array(ends)


def mix(values: np.ndarray, salt: int) -> np.ndarray:
    """A fresh permutation of 64-bit values for every salt."""
    out = (values ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))
