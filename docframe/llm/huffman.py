"""Canonical length-limited Huffman codes over numpy arrays.

Streams are cut into independent blocks. A block holds whole documents, its bits start at a byte, and it keeps
the bit offset of every SPACING-th symbol: from there on decoders run side by side, one table look-up a symbol.
"""

from __future__ import annotations

import numpy as np

SPACING = 512


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Package-merge: lengths of at most `limit` bits with the least total, 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    packages, leaves = np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate((weight, packages))
        sort = np.argsort(both, kind="stable")
        leaves.append(np.cumsum(sort < n))
        both = both[sort]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * (n - 1)
    for count in reversed(leaves):
        if take == 0:
            break
        own = int(count[take - 1])
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, then ascending symbols."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.limit, self.lengths = limit, lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        width = self.lengths[order]
        step = np.int64(1) << (limit - width)
        start = np.cumsum(step) - step  # of each symbol's entries in a table of 2**limit
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = start >> (limit - width)
        self.symbol = np.zeros(1 << limit, np.uint32)
        self.width = np.ones(1 << limit, np.uint8)
        total = int(step.sum())
        self.symbol[:total] = np.repeat(order, step)
        self.width[:total] = np.repeat(width, step)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits of one block, bit offset of every SPACING-th symbol)."""
        width = self.lengths[ids]
        end = np.cumsum(width)
        at = end - width
        words = np.zeros((int(end[-1]) + 31) // 32 + 1 if len(ids) else 0, np.uint64)
        if len(ids):
            shifted = self.codes[ids].astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
            word = at >> 5
            new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            words[word[new]] = np.add.reduceat(shifted >> np.uint64(32), new)
            words[word[new] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), new)
        bits = words.astype(">u4").tobytes()
        return bits[: (int(end[-1]) + 7) // 8 if len(ids) else 0], at[::SPACING]

    def decode(self, blocks: list[bytes], offsets: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        """The ids of the blocks one behind the other. All checkpoints advance together."""
        data = np.frombuffer(b"".join([*blocks, b"\0" * 8]), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        begin = np.cumsum([0, *map(len, blocks)])[:-1] * 8
        at = np.concatenate([np.asarray(o, np.int64) + b for o, b in zip(offsets, begin)] or [np.zeros(0, np.int64)])
        left = np.concatenate([np.minimum(SPACING, s - np.arange(len(o)) * SPACING) for o, s in zip(offsets, sizes)] or [np.zeros(0, np.int64)])
        order = np.argsort(-left, kind="stable")
        at, rest = at[order], left[order]
        out = np.zeros((int(rest[0]) if len(rest) else 0, len(rest)), np.uint32)
        keep = np.uint32(32 - self.limit)
        live = len(rest)
        for t in range(len(out)):
            while rest[live - 1] <= t:
                live -= 1
            p = at[:live]
            entry = (window[p >> 3] << (p & 7).astype(np.uint32)) >> keep
            out[t, :live] = self.symbol[entry]
            p += self.width[entry]
        lanes = np.empty_like(order)
        lanes[order] = np.arange(len(order))
        back = out.T[lanes]
        return back[np.arange(len(out)) < left[:, None]] if len(out) else np.zeros(0, np.uint32)
