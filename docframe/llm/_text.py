"""Bytes, words and hashes of whole texts, vectorised over chunks of documents.

A chunk holds whole documents of about CHUNK bytes together (a longer document is a chunk of its own),
so the arrays below stay small and in cache. All hashes are 64 bit and depend on content and a seed alone.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
#: Words beyond so many bytes are hashed by a digest, one by one.
LONG = 256
_PAD = b"\0" * 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U)

#: Bytes that words are made of. SPACED: anything but ASCII white space; ALNUM: 0-9, letters, all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


@cache
def factors(seed: int) -> np.ndarray:
    """Random odd numbers. A seed is drawn for each run where equal hashes are taken for equal things: then nobody
    can have made texts whose hashes collide."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 1024, dtype=np.uint64) << U(1) | U(1)


def new_seed() -> int:
    return int.from_bytes(os.urandom(8), "little")


def view(buffer: bytes) -> np.ndarray:
    """The eight bytes from each place on as a number; the last eight bytes of the buffer are padding."""
    return np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, strides=(1,))


def chain(values: np.ndarray, start: np.ndarray, count: np.ndarray, salt: np.uint64, step: int = 1) -> np.ndarray:
    """Hash of count[i] values, step apart, from start[i] on, taken in one after the other."""
    order = np.argsort(-count, kind="stable")
    s, c = start[order].astype(np.int64), count[order]
    h = mix(np.full(len(s), salt, U) + c.astype(U))
    live = len(c)
    for t in range(int(c[0]) if len(c) else 0):
        live = int(np.searchsorted(-c[:live], -t, "left"))
        h[:live] = mix((h[:live] ^ values[s[:live] + t * step]) + salt)
    out = np.empty_like(h)
    out[order] = h
    return out


def spans(eight: np.ndarray, start: np.ndarray, size: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Hash of size[i] bytes from start[i] on; eight is their view(). Different ones of up to seven bytes differ."""
    first = eight[start] & _MASK[np.minimum(size, 8)]
    out = mix((first | (np.minimum(size, 8) % 8).astype(U) << U(56)) ^ salt)
    more = np.flatnonzero(size > 7)
    if len(more):
        s, n = start[more], size[more]
        # whole blocks, then the last eight bytes, which may overlap them
        out[more] = mix((chain(eight, s, n // 8, salt ^ U(0x9FB21C651E98DF25), 8) ^ eight[s + n - 8]) + n.astype(U))
    return out


def equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mask: size[i] bytes from at[i] on in the view a are those from to[i] on in b."""
    mask = _MASK[np.minimum(size, 8)]
    out = (a[at] & mask) == (b[to] & mask)
    go, done = np.flatnonzero(out & (size > 8)), 8
    while len(go):
        mask = _MASK[np.minimum(size[go] - done, 8)]
        same = (a[at[go] + done] & mask) == (b[to[go] + done] & mask)
        out[go[~same]] = False
        done += 8
        go = go[same & (size[go] > done)]
    return out


def grams(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k values from each place on (of none if there are fewer)."""
    n, f = max(0, len(values) - k + 1), factors(seed)
    out = np.zeros(n, U)
    for j in range(k):
        out += values[j : j + n] * f[j]
    return mix(out)


class Chunk:
    """Documents joined with a space behind each; at[i] is where document i begins, size[i] its bytes."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buffer = b" ".join([*texts, _PAD])
        self.data = np.frombuffer(self.buffer, np.uint8, len(self.buffer) - 8)
        self.eight = view(self.buffer)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(self.size + 1)[:-1])) if texts else np.zeros(0, np.int64)

    def words(self, kind: np.ndarray, fold: bool = False, seed: int = 1) -> None:
        """Sets start, end, hash of each word and lo, hi: the words of document i are lo[i]..hi[i]-1.

        With fold A-Z are taken as a-z, in hashes and in eight.
        """
        edge = np.diff(kind[self.data].astype(np.int8), prepend=0, append=0)
        if fold:
            self.buffer = self.buffer.translate(_LOWER)
            self.eight = view(self.buffer)
        self.cut(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), seed)

    def cut(self, start: np.ndarray, end: np.ndarray, seed: int = 1) -> None:
        """The same for given words."""
        self.start, self.end = start, end
        size, salt = end - start, factors(seed)[-1]
        self.hash = spans(self.eight, start, np.minimum(size, LONG), salt)
        key = int(salt).to_bytes(8, "little")
        for i in np.flatnonzero(size > LONG).tolist():
            self.hash[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8, key=key).digest(), "little")
        self.lo = np.searchsorted(self.start, self.at)
        self.hi = np.searchsorted(self.start, self.at + self.size)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]

    def exact(self) -> np.ndarray:
        """A number for each word, the same for equal bytes alone."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        _, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
        size, to = self.end - self.start, first[number]
        same = (size == size[to]) & equal(self.eight, self.start, self.eight, self.start[to], np.minimum(size, size[to]))
        odd: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            number[i] = odd.setdefault(self.word(i), len(first) + len(odd))
        return number


def chunks(texts: list[bytes | None], size: int = CHUNK, most: int = 1000) -> Iterator[tuple[int, int, Chunk]]:
    """(first, behind the last, chunk) over a batch's texts, `most` in a chunk; null counts as empty."""
    first, total = 0, 0
    texts = [t or b"" for t in texts]
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size or i + 1 - first == most or i + 1 == len(texts):
            yield first, i + 1, Chunk(texts[first : i + 1])
            first, total = i + 1, 0


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive values, counts[i] in row i."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then the same for 1, 2, ..."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(start, np.int64) - first, count)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few rows at a time become Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
