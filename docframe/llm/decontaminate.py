"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of the benchmark items are the patterns, sequences of word hashes. For patterns of equal length a
shift table by the hash of a two-word block tells how far a search place can jump: as far as the block's last
position in any pattern allows. Where the jump is 0 the block ends some pattern: the bucket of patterns with
that suffix is compared word by word, first by hashes, then by bytes. All documents of a chunk are searched
together, one place per segment.

Patterns are taken in blocks of bounded size, so the benchmark may be of any size. Of several blocks, each is searched
for in those documents only that a Bloom filter of all windows lets through, so the documents are read twice at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import added, doc_id, keyed, materialise, ship
from ._text import ALNUM, Chunk, U, chunks, equal, grams, mix, ranges, raw, view
from .repeats import covered

#: Patterns in a block, windows in a segment, entries of a shift table, bits of a Bloom filter for each window and at most
#: (beyond, more documents pass it).
PATTERNS, SEGMENT, TABLE, BITS, FILTER = 200_000, 256, 1 << 18, 16, 1 << 30


class WuManber:
    """Search for the rows of patterns, all of one length; owners[i] are the items that have pattern i."""

    def __init__(self, patterns: np.ndarray, owners: list[list[str]]):
        self.size = m = patterns.shape[1]
        self.block = b = min(2, m)
        self.shift = np.full(TABLE, m - b + 1, np.int64)
        for at in range(m - b + 1):
            np.minimum.at(self.shift, self._hash(patterns[:, at : at + b]) & U(TABLE - 1), m - b - at)
        suffix = self._hash(patterns[:, m - b :])
        self.order = order = np.argsort(suffix, kind="stable")
        self.suffix, self.patterns, self.owners = suffix[order], patterns[order], [owners[i] for i in order]

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return mix(block[:, 0] * U(3) + block[:, -1]) if self.block == 2 else mix(block[:, 0])

    def search(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of all occurrences that lie inside some lo[i]..hi[i]-1, by place."""
        m, b = self.size, self.block
        windows = np.maximum(hi - lo - m + 1, 0)
        parts = -(-windows // SEGMENT)
        start = np.repeat(lo, parts) + ranges(np.zeros(len(lo)), parts) * SEGMENT
        stop = np.minimum(start + SEGMENT, np.repeat(lo + windows, parts))
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(start):
            last = start + m - 1
            block = self._hash(np.stack((words[last - b + 1], words[last]), 1))
            jump = self.shift[block & U(TABLE - 1)]
            here = np.flatnonzero(jump == 0)
            first = np.searchsorted(self.suffix, block[here], "left")
            count = np.searchsorted(self.suffix, block[here], "right") - first
            pattern, place = ranges(first, count), np.repeat(start[here], count)
            for j in range(m):
                same = self.patterns[pattern, j] == words[place + j]
                pattern, place = pattern[same], place[same]
            places.append(place)
            found.append(pattern)
            start = start + np.maximum(jump, 1)
            live = start < stop
            start, stop = start[live], stop[live]
        place, pattern = np.concatenate(places), np.concatenate(found)
        order = np.argsort(place, kind="stable")
        return place[order], pattern[order]


class Windows:
    """Windows of m words, known by their bytes: hashes to search for, owners, and where each word is in buffer."""

    def __init__(self, m: int, found: dict[bytes, set[str]], hashes: dict[bytes, np.ndarray]):
        texts = sorted(found)
        self.search = WuManber(np.stack([hashes[t] for t in texts]), [sorted(found[t]) for t in texts])
        self.m, self.buffer = m, b" ".join([*(texts[i] for i in self.search.order.tolist()), b"\0" * 8])
        gap = np.flatnonzero(np.frombuffer(self.buffer, np.uint8) == 0x20)  # behind each word
        self.end = gap.reshape(-1, m)
        self.start = np.concatenate(([0], gap[:-1] + 1)).reshape(-1, m)

    def occurrences(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) in the chunk's documents. What the search finds is compared byte by byte."""
        place, window = self.search.search(c.hash, c.lo, c.hi)
        eight = view(self.buffer)
        for j in range(self.m):
            size = c.end[place + j] - c.start[place + j]
            same = size == self.end[window, j] - self.start[window, j]
            place, window, size = place[same], window[same], size[same]
            same = equal(c.eight, c.start[place + j], eight, self.start[window, j], size)
            place, window = place[same], window[same]
        return place, window


def tables(items: list[tuple[str, bytes]], size: int) -> list[Windows]:
    """The items' windows of `size` words, by length; a shorter item is one window."""
    by_length: dict[int, dict[bytes, set[str]]] = {}
    hashes: dict[bytes, np.ndarray] = {}
    for i, _, c in chunks([t for _, t in items], most=1 << 30):
        c.words(ALNUM, fold=True)
        for name, lo, hi in zip((n for n, _ in items[i:]), c.lo.tolist(), c.hi.tolist()):
            m = min(size, hi - lo)
            own = [c.word(w) for w in range(lo, hi)]
            for at in range(hi - lo - m + 1) if m else ():
                text = b" ".join(own[at : at + m])
                by_length.setdefault(m, {}).setdefault(text, set()).add(name)
                hashes[text] = c.hash[lo + at : lo + at + m]
    return [Windows(m, found, hashes) for m, found in sorted(by_length.items())]


def hits(c: Chunk, searchers: list[Windows]) -> tuple[np.ndarray, dict[int, set[str]]]:
    """(mask of the chunk's words inside an occurrence, items found by document)."""
    edge = np.zeros(len(c.hash) + 1, np.int64)
    found: dict[int, set[str]] = {}
    for s in searchers:
        place, pattern = s.occurrences(c)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + s.m, -1)
        doc = np.searchsorted(c.lo, place, "right") - 1
        for d, p in np.unique(np.stack((doc, pattern), 1), axis=0).tolist():
            found.setdefault(d, set()).update(s.search.owners[p])
    return np.cumsum(edge)[:-1] > 0, found


def _blocks(rows: Iterator, size: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most PATTERNS windows (an item with more is cut, with overlap)."""
    block, n = [], 0
    for r in rows:
        name, text = "" if r["item_id"] is None else str(r["item_id"]), (r["text"] or "").encode("utf-8", "surrogatepass")
        c = Chunk([text])
        c.words(ALNUM)
        words = len(c.start)
        for at in range(0, max(1, words - size + 1), PATTERNS):
            end = min(words, at + PATTERNS + size - 1)
            part = text if words <= PATTERNS else c.buffer[c.start[at] : c.end[end - 1]]
            if n and n + end - at > PATTERNS:
                yield block
                block, n = [], 0
            block.append((name, part))
            n += end - at
    yield block


class Sieve:
    """A Bloom filter, with two places for each window."""

    def __init__(self, windows: int):
        self.bits = np.zeros(min(FILTER, 1 << max(6, (BITS * windows - 1).bit_length())) // 8, np.uint8)
        self.lengths: set[int] = set()

    def _places(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        places = (h & U(8 * len(self.bits) - 1), (h >> U(32)) & U(8 * len(self.bits) - 1))
        return [((p >> U(3)).astype(np.int64), np.uint8(1) << (p & U(7)).astype(np.uint8)) for p in places]

    def add(self, c: Chunk, size: int) -> None:
        """All windows of the chunk's items."""
        for lo, hi in zip(c.lo.tolist(), c.hi.tolist()):
            if m := min(size, hi - lo):
                self.lengths.add(m)
                for at, bit in self._places(grams(c.hash[lo:hi], m, 1)):
                    np.bitwise_or.at(self.bits, at, bit)

    def passes(self, c: Chunk) -> np.ndarray:
        """Mask of the chunk's documents that may have a window."""
        out = np.zeros(len(c.lo), bool)
        for m in self.lengths:
            h = grams(c.hash, m, 1)
            hit = np.ones(len(h), bool)
            for at, bit in self._places(h):
                hit &= (self.bits[at] & bit) > 0
            place = np.flatnonzero(hit)
            doc = np.searchsorted(c.lo, place, "right") - 1
            doc = doc[place + m <= c.hi[doc]]
            out[doc] = True
        return out


def _windows(benchmark: DataFrame, size: int) -> Iterator[int]:
    """How many each item has at most."""
    for r in benchmark.select(F.length("text").alias("n")).toLocalIterator():
        yield (r["n"] or 0) // 2 + 1


def _sifted(held):
    """(id, th, n_words, text) of all documents; text is null where no window can occur."""

    def run(batches):
        for b in batches:
            for i, j, c in chunks(raw(b.column("text"))):
                c.words(ALNUM, fold=True)
                text = b.column("text").slice(i, j - i)
                out = held.value.passes(c)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(c.hi - c.lo, pa.int64()), pc.if_else(pa.array(out), text, pa.scalar(None, text.type))],
                    ["id", "th", "n_words", "text"],
                )

    return run


_FOUND = "id long, th long, n long, spans array<struct<at: long, to: long>>, items array<string>"


def _digest(spans: list[tuple[int, int]], items: set[str]) -> tuple[int, int, str]:
    return sum(z - a for a, z in covered(spans)), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """How much of each document occurs in the benchmark's windows of `size` words.

    Takes doc_id and text, item_id and text. A-Z are lower-cased; words are runs of 0-9, a-z and everything
    beyond ASCII. An item with fewer words is one window, one without words or text none. Returns text and rest
    (see unkeyed()), doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256 (of the found
    item_ids, sorted as strings and joined by commas) and contaminated. Null and empty texts have no words; very
    long ones are searched whole; repeated rows each have their own row; repeated items count once; a null item_id
    is named by the empty string; other columns are kept in rest, whatever their names; an empty benchmark hits
    nothing, and empty documents give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = keyed(docs, keep=True)
    items = benchmark.select("item_id", "text").toLocalIterator()
    counts = "n_words long, n_hit long, n_items long, items_sha256 string"
    names = ["n_words", "n_hit", "n_items", "items_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def scan(block, whole: bool):
        def run(batches):
            searchers = block.value
            for b in batches:
                ids, ths = ([], []) if whole else (b.column("id").to_pylist(), b.column("th").to_pylist())
                for i, j, c in chunks(raw(b.column("text"))):
                    c.words(ALNUM, fold=True)
                    mask, found = hits(c, searchers)
                    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
                    at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    spans: dict[int, list[tuple[int, int]]] = {}
                    for d, a, z in zip((np.searchsorted(c.lo, at, "right") - 1).tolist(), at.tolist(), to.tolist()):
                        while z > (end := int(c.hi[d])):  # hits may go on over the end of a document
                            if end > a:
                                spans.setdefault(d, []).append((a - int(c.lo[d]), end - int(c.lo[d])))
                            a, d = max(a, end), d + 1
                        spans.setdefault(d, []).append((a - int(c.lo[d]), z - int(c.lo[d])))
                    n = (c.hi - c.lo).tolist()
                    if whole:
                        rows = [(n[k], *_digest(spans.get(k, []), found.get(k, set()))) for k in range(j - i)]
                        own = [b.column(x).slice(i, j - i) for x in ("id", "text", "rest")]
                        yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], ["id", "text", "rest", *names])
                    else:
                        rows = [(ids[i + k], ths[i + k], n[k], [{"at": a, "to": z} for a, z in spans.get(k, [])], sorted(found.get(k, ()))) for k in range(j - i)]
                        yield pa.RecordBatch.from_pylist(
                            [dict(zip(("id", "th", "n", "spans", "items"), r)) for r in rows],
                            pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("spans", pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))), ("items", pa.list_(pa.string()))]),
                        )

        return run

    blocks = _blocks(items, size)
    first, second = next(blocks), next(blocks, None)
    send_ = spark.sparkContext.broadcast
    send = lambda b: send_(tables(b, size))
    if second is None:
        rows = docs.select("id", "text", "rest")
        out = rows.mapInArrow(scan(send(first), True), added(rows, counts))
    else:
        sieve, rest = Sieve(sum(_windows(benchmark, size))), benchmark.select("item_id", "text").toLocalIterator()
        for r in rest:
            c = Chunk([(r["text"] or "").encode("utf-8", "surrogatepass")])
            c.words(ALNUM, fold=True)
            sieve.add(c, size)
        passed = materialise(docs.select("id", "th", "text").mapInArrow(_sifted(send_(sieve)), "id long, th long, n_words long, text string"))
        sizes = passed.select("id", "th", "n_words").dropDuplicates(["id", "th"])
        some, parts = passed.filter("text is not null").dropDuplicates(["id", "th"]), []
        for block in (first, second, *blocks):
            part = materialise(some.select("id", "th", "text").mapInArrow(scan(held := send(block), False), _FOUND))
            held.unpersist()
            parts.append(part.filter("size(spans) > 0").select("id", "th", "spans", "items"))
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        merged = every.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

        def finish(batches):
            for b in batches:
                rows = [
                    (r["id"], r["th"], r["n_words"], *_digest([(s["at"], s["to"]) for s in r["spans"] or ()], set(r["items"] or ())))
                    for r in b.to_pylist()
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int64(), *kinds])], ["id", "th", *names])

        out = docs.join(sizes.join(merged, ["id", "th"], "left").mapInArrow(finish, "id long, th long, " + counts), ["id", "th"])
    return out.select("text", "rest", doc_id(), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
