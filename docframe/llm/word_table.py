"""What a worker has found out about words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._text import Chunk, U, equal, ranges, view

#: Words that a table holds before it is cleared, and their bytes.
WORDS, BYTES = 1 << 20, 1 << 26


class _Pool:
    """An array that grows."""

    def __init__(self, kind: str):
        self.values, self.used = np.zeros(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> int:
        """Where more begins."""
        at = self.used
        if at + len(more) + 8 > len(self.values):
            self.values = np.concatenate((self.values[:at], more, np.zeros(at + len(more) + 8, self.values.dtype)))
        self.values[at : at + len(more)] = more
        self.used += len(more)
        return at


class WordTable:
    """Ids by word: open addressing over numpy arrays, so whole arrays of words are looked up at once.

    A slot is found by a word's hash and then holds if the bytes are the same. Words that meet another one with
    their hash are kept apart in a dictionary.
    """

    def __init__(self, width: str, words: int = WORDS):
        self.width, self.limit = width, words
        self.clear(words)

    def look_up(self, c: Chunk, make: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunk's words one behind the other, where each word's begin, and the end).

        make gives the ids of words that aren't known yet, as bytes of width.
        """
        if self.words + len(c.start) > self.limit or self.bytes.used > BYTES:
            self.clear(max(self.limit, len(c.start)))
        size = c.end - c.start
        key = np.maximum(c.hash, U(1))
        slot = self.find(key)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first = np.unique(key[missing], return_index=True)
            self.add(new, [c.word(i) for i in missing[first].tolist()], make)
            slot[missing] = self.find(key[missing])
        start, count = self.start[slot], self.count[slot]
        known = self.size[slot]
        same = (known == size) & equal(c.eight, c.start, view(self.bytes.values.data), self.place[slot], np.minimum(known, size))
        odd = np.flatnonzero(~same)
        if len(odd):
            words = [c.word(i) for i in odd.tolist()]
            new_ = sorted(set(words) - self.odd.keys())
            self.odd |= zip(new_, zip(*(x.tolist() for x in self._ids(make(new_)))))
            start[odd], count[odd] = zip(*(self.odd[w] for w in words))
        return self.ids.values[ranges(start, count)], np.concatenate(([0], np.cumsum(count)))

    def clear(self, words: int) -> None:
        self.mask = (1 << (2 * words - 1).bit_length()) - 1
        self.key = np.zeros(self.mask + 1, U)
        self.start, self.count, self.place, self.size = (np.zeros(self.mask + 1, k) for k in (np.uint32, np.int32, np.int32, np.int32))
        self.ids, self.bytes, self.words, self.odd = _Pool(self.width), _Pool("u1"), 0, {}

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it isn't there."""
        slot = (key & U(self.mask)).astype(np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            here = self.key[slot[open_]]
            slot[open_[here == 0]] = -1
            open_ = open_[(here != key[open_]) & (here != 0)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return slot

    def _ids(self, made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) of each in the pool."""
        flat = np.frombuffer(b"".join(made), self.width)
        count = np.fromiter(map(len, made), np.int64, len(made)) // flat.itemsize
        return self.ids.add(flat) + np.cumsum(count) - count, count

    def add(self, key: np.ndarray, words: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> None:
        """Different keys that aren't there yet."""
        start, count = self._ids(make(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        place = self.bytes.add(np.frombuffer(b"".join(words), np.uint8)) + np.cumsum(size) - size
        slot, left = (key & U(self.mask)).astype(np.int64), np.arange(len(key))
        while len(left):
            at, first = np.unique(slot[left], return_index=True)
            free = self.key[at] == 0
            at, won = at[free], left[first[free]]
            self.key[at], self.start[at], self.count[at], self.place[at], self.size[at] = key[won], start[won], count[won], place[won], size[won]
            rest = np.ones(len(left), bool)
            rest[first[free]] = False
            left = left[rest]
            slot[left] = (slot[left] + (self.key[slot[left]] != 0)) & self.mask
        self.words += len(key)
