"""Suffix-array dedup: bytes under repeated strings are removed.

Contexts that share an anchor (see repeats.py) form a shard. A shard's suffix array is built by
Larsson-Sadakane refinement: a first order by eight bytes, then groups of equal rank only are refined by the
rank h bytes on, h doubling until the order reaches past the string length. Kasai's pass over it, in lockstep
over all contexts, gives common prefixes; a place is repeated where one reaches the length, or if it stands for
several occurrences of its context. Shards that share an anchor are merged by binary search of each other's strings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import doc_id
from ._text import new_seed
from .repeats import OWN, Repeats, Shard, Windows, find, removed, runs

GRAM = 32


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, key): places sorted by at least depth bytes; rank is equal where those are; key has eight bytes."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)

    def ranked(places: np.ndarray, values: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Sets ranks of places sorted by values, at index of the order; returns what must be refined."""
        new = np.concatenate(([True], values[1:] != values[:-1]))
        group = np.cumsum(new) - 1
        rank[places] = index[np.flatnonzero(new)][group]
        return index[np.bincount(group)[group] > 1]

    open_ = ranked(order, key[order], np.arange(n)) if n else order
    h = 8
    while h < depth and len(open_):
        places = order[open_]
        ahead = places + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        values = (rank[places] << 32) | second
        sort = np.argsort(values)
        order[open_] = places = places[sort]
        open_ = ranked(places, values[sort], open_)
        h *= 2
    return order, rank, key


def common_prefixes(shard: Shard, sa: np.ndarray, rank: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
    """Kasai: for each place of sa, the bytes (limit at most) it has in common with the one before it.

    All contexts advance together by one place a step. From one place to the next a common prefix shrinks by
    one at most, if the place before it has a successor of its own and the prefix wasn't cut off at limit.
    """
    data, n = shard.units, len(shard.units)
    before = np.full(n + 1, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    inside = np.zeros(n + 2, bool)
    inside[sa] = True
    lcp = np.zeros(n, np.int32)
    by_length = np.argsort(-shard.count, kind="stable")
    first, count = shard.first[by_length], shard.count[by_length]
    length, last = np.zeros(len(first), np.int64), np.full(len(first), n, np.int64)
    wide = n - 8
    for t in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -t, "left"))
        p = first[:live] + t
        q = before[p]
        had, was = length[:live], last[:live]
        size = np.where(inside[was + 1] & (had < limit), np.maximum(had - 1, 0), 0)
        size[q < 0] = 0
        some = np.flatnonzero(q >= 0)
        equal = rank[p[some]] == rank[q[some]]  # as far as the order reaches
        size[some[equal]] = limit
        go = some[~equal]
        while len(go):  # eight bytes a step
            i, j = p[go] + size[go], q[go] + size[go]
            go = go[(size[go] + 8 <= limit) & (np.maximum(i, j) <= wide) & (key[i] == key[j])]
            size[go] += 8
        go = some[~equal]
        while len(go):
            go = go[size[go] < limit]
            go = go[data[p[go] + size[go]] == data[q[go] + size[go]]]
            size[go] += 1
        lcp[p], length[:live], last[:live] = size, size, np.where(q >= 0, q, n)
    return lcp[sa]


def _found(s: Shard, sa: np.ndarray, guests: np.ndarray, size: int) -> np.ndarray:
    """Places of sa (suffixes sorted by size bytes) that begin with the size bytes from one of guests on, the first
    of each: all binary searches go side by side, eight bytes at a time."""
    blocks = np.ndarray(s.chunk.eight.shape, ">u8", s.chunk.buffer, strides=(1,))
    steps = (*range(0, size - 8, 8), size - 8) if size >= 8 else ()

    def order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0, 1: how the bytes from a on compare with those from b on."""
        out, go = np.zeros(len(a), np.int8), np.arange(len(a))
        for j in steps or range(size):
            x, y = (blocks[a[go] + j], blocks[b[go] + j]) if steps else (s.units[a[go] + j], s.units[b[go] + j])
            out[go] = (x > y).astype(np.int8) - (x < y)
            go = go[x == y]
        return out

    low, high = np.zeros(len(guests), np.int64), np.full(len(guests), len(sa), np.int64)
    while (go := np.flatnonzero(low < high)).size:
        middle = (low[go] + high[go]) // 2
        less = order(sa[middle], guests[go]) < 0
        low[go], high[go] = np.where(less, middle + 1, low[go]), np.where(less, high[go], middle)
    inside = np.flatnonzero(low < len(sa))
    return np.unique(low[inside[order(sa[low[inside]], guests[inside]) == 0]])


def repeated(s: Shard, w: Windows) -> Repeats:
    """Strings of the shard's suffix array that have an equal neighbour or stand for several occurrences of their
    context, and those that a binary search for other shards' strings finds."""
    none = np.zeros(0, np.int64)
    if not len(s.start):
        return none, none, none, none
    order, rank, key = suffix_array(s.units, w.size)
    starts = np.zeros(len(s.units), bool)
    starts[s.start[~s.guest[s.of]]] = True
    sa = order[starts[order]]
    lcp = common_prefixes(s, sa, rank, key, w.size) >= w.size
    hit = np.zeros(len(s.units), bool)
    hit[sa[lcp]] = True
    hit[sa[np.flatnonzero(lcp) - 1]] = True
    if s.guest.any():
        same = np.cumsum(~lcp)  # a number for each group of equal strings
        at = _found(s, sa, s.start[s.guest[s.of]], w.size)
        hit[sa[np.isin(same, same[at])]] = True
    c, a, z = runs(s, (hit[s.start] | s.more[s.of]) & ~s.guest[s.of], w)
    return c, a, z, np.full(len(c), OWN)


def suffix_dedup(docs: DataFrame, length: int = 200, keep_text: bool = False) -> DataFrame:
    """Removes each byte under a string of `length` bytes that also starts at another place of any document.

    Takes doc_id and text (UTF-8 bytes; null: empty), returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, and kept (text left; bytes of cut characters as U+FFFD; null where nothing
    was removed) with keep_text. Strings never cross documents. Repeated rows count as documents of their own;
    a null doc_id stays null; empty texts and those shorter than `length` lose nothing, very long ones are taken
    whole; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    w = Windows(False, length, min(GRAM, length), new_seed())
    out = removed(find(docs, w, repeated, earlier=False), w, keep_text)
    more = ["kept"] if keep_text else []
    return out.select(doc_id(), F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), *more)
