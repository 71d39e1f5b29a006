"""Ids of distinct words, remembered by a task."""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa

from flowtrace.llm.arrays import ranges

#: Words a task remembers before it starts afresh.
KNOWN_WORDS = 400_000


class Lexicon:
    """Ids of words, each encoded on first sight."""

    def __init__(self, encode, most: int = KNOWN_WORDS):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.place: dict[bytes, int] = {}
        self.flat, self.size = array("I"), array("q")

    def ids(self, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each) for codes of
        distinct words."""
        distinct = words.to_pylist()
        if len(self.place) > self.most:
            self._clear()
        fresh = [w for w in distinct if w not in self.place]
        encoded = self.encode(fresh)
        sizes = array("q", map(len, encoded))
        self.place.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh))))
        self.size.extend(sizes)
        self.flat.extend(chain.from_iterable(encoded))
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        size = np.array(self.size, np.int64)
        first, sizes = (np.cumsum(size) - size)[at][codes], size[at][codes]
        return np.array(self.flat, np.uint32)[ranges(first, sizes)], sizes
