"""N-gram Jaccard join by universe partitioning and pigeonhole.

A document is the set of the 64-bit hashes of its shingles, with a seed drawn for each run. Equal sets are one class,
known by 128 bits of signature. Bands of set sizes are chosen so that a partner lies in the same or a neighbouring band. For band j
at most H_j elements differ between partners, so the universe of hashes is cut into H_j + 1 segments, and every
class of band j, and of band j + 1 with band j's segments, gives the keys (band, segment, elements in it).

Allocation: a class needs sum(v) > H for its own bound H, where a segment with v = 1 must be equal, one with
v = 2 may differ by one element and one with v = 0 is not probed. Segments with few elements are the costly
ones (many classes share them), so as many of the smallest as the sum allows get 0, empty ones first. What then
is missing is given back by v = 2 on the first segments, for which all classes index one-deletion neighbourhoods.
Classes for which that isn't enough find each other by the prefixes of their sorted sets.

Classes with a common key are candidates and are verified on the words of their whole texts. In a first round each key's
members are compared with its least one only, in a few more one member of each component with other members, as long as
that links many. What then still does is compared in blocks, where each two components that come near are linked by their
nearest members first; only components that this doesn't link are compared as wholes. So groups of near copies never make all their pairs, and no
link between components is lost.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import NO_ID, discard, doc_id, keyed, materialise, ship
from ._text import _LOWER, SPACED, Chunk, U, chain, chunks, factors, grams, mix, new_seed, ranges, raw
from .components import components, joined

#: Keys in a bucket, keys held by a task before it sends them, members compared with one centre at once, members
#: in a block, rows in a task that compares blocks, bytes of text in a verifying group, rows of numbers broadcast,
#: classes of a key in a task beyond which they stay there.
BUCKET, HELD, CENTRE, BLOCK, PLACE, GROUP_BYTES, BROADCAST, CROWD = 1 << 19, 1 << 20, 256, 512, 1 << 12, 4 << 20, 1 << 20, 256
#: Rounds with other centres before all members of different components are compared, centres of a class in each, pairs
#: for each link beyond which a round is the last one, and bits of a parity for each element: the more, the fewer pairs
#: that aren't linked come near, and the more is shuffled.
ROUNDS, CENTRES, PAYS, SHARP = 2, 4, 32, 1
_C1, _C2, _C3 = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)


@dataclass(frozen=True)
class Similarity:
    """Sets of shingles of `words` words; linked where den * |A and B| >= num * |A or B|."""

    words: int = 5
    num: int = 80
    den: int = 100
    seed: int = 1

    @cached_property
    def bands(self) -> np.ndarray:
        """Least set size of each band."""
        low = [1, 2]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, self.den * (low[-1] - 1) // self.num + 1))
        return np.array(low, np.int64)

    def differing(self, total):
        """Most elements in which two linked sets of `total` elements together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


class Sets:
    """The sets of a chunk: element[first[i]:first[i + 1]] are the sorted hashes of document i.

    signature and check are two hashes of a set; together they are its identity.
    """

    def __init__(self, chunk: Chunk, sim: Similarity):
        chunk.words(SPACED, fold=True, seed=sim.seed)
        k, n = sim.words, chunk.hi - chunk.lo
        many = np.maximum(n - k + 1, 0)
        short = (n > 0) & (n < k)
        whole = grams(chunk.hash, k, sim.seed)
        hashes = np.empty(int(many.sum() + short.sum()), U)
        end = np.cumsum(many + short)
        first = end - many - short
        hashes[ranges(first, many)] = whole[ranges(chunk.lo, many)]
        hashes[first[short]] = chain(chunk.hash, chunk.lo[short], n[short], _C1)
        new = np.ones(len(hashes), bool)
        for a, z in zip(first[many > 1].tolist(), end[many > 1].tolist()):
            part = hashes[a:z]
            part.sort()
            new[a + 1 : z] = part[1:] != part[:-1]
        self.element = hashes[new]
        self.first = np.concatenate(([0], np.cumsum(new)))[np.append(first, len(hashes))]
        self.size = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(n)), self.size)
        self.mixed = mix(self.element + _C1)
        self.signature, self.check = (
            mix(self._sums(x) + self.size.astype(U) * _C2).view(np.int64) for x in (self.mixed, mix(self.element ^ factors(sim.seed)[-2]))
        )

    def _sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, U), np.cumsum(values)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def classes(self, clash: np.ndarray) -> np.ndarray:
        """The number of each set's class: its signature, or both hashes as one where different sets have that signature."""
        hit = np.isin(self.signature, clash)
        return np.where(hit, self.other(), self.signature) if hit.any() else self.signature

    def other(self) -> np.ndarray:
        return mix(self.signature.view(U) ^ mix(self.check.view(U) + _C3)).view(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.element[self.first[i] : self.first[i + 1]]


def _grouped(values: np.ndarray, pick: np.ndarray, n: int) -> np.ndarray:
    """For each picked entry its rank among those of its value (values ascend), else n."""
    out = np.full(len(values), n, np.int64)
    own = values[pick]
    if len(own):
        out[pick] = np.arange(len(own)) - np.searchsorted(own, own)
    return out


def keys(sets: Sets, use: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the documents in the mask use. The lowest bit of a key says that it is probed, the next is 0."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    bands = sim.bands
    own = np.searchsorted(bands, sets.size, "right") - 1
    for below in (0, 1):
        band = own - below
        live = use & (sets.size > 0) & (band >= 0)
        if not live.any():
            continue
        safe = np.maximum(band, 0)
        largest = bands[safe + 1] - 1
        reach = largest * sim.den // sim.num
        segments = sim.differing(largest + reach) + 1
        partner = largest if below else np.minimum(sets.size * sim.den // sim.num, bands[safe + 2] - 1)
        needed = sim.differing(sets.size + partner) + 1
        wide = np.minimum(segments, segments // 16 + 6)

        take = live[sets.doc]
        doc, element, mixed = sets.doc[take], sets.element[take], sets.mixed[take]
        seg = (((element >> U(32)) * segments[doc].astype(U)) >> U(32)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1]))))
        count = np.diff(np.append(new, len(doc)))
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mixed)))
        total = sums[new + count] - sums[new]
        d, s = doc[new], seg[new]
        salt = mix((safe[d].astype(U) << U(32)) + s.astype(U) + _C3)
        exact, deleted = lambda x, salt=salt: mix(x ^ salt), lambda x, salt=salt: mix(x + salt)

        filled = np.bincount(d, minlength=len(own))
        spare = segments - needed - (segments - filled)  # below 0: so many must come from v = 2
        by_size = np.lexsort((count, d))
        rank = np.empty(len(d), np.int64)
        rank[by_size] = np.arange(len(d)) - np.searchsorted(d, d)
        probed = rank >= np.maximum(spare, 0)[d]
        fits = (s < wide[d]) & (count > 1)
        twice = _grouped(d, fits, 1 << 60) < np.maximum(-spare, 0)[d]
        short = live & (np.bincount(d[fits], minlength=len(own)) < -spare)

        flag = lambda k, on: (k & ~U(3)) | on.astype(U)
        out.append((d, flag(exact(total), probed)))
        for pick, salted, on in ((s < wide[d], "deleted", False), (twice, "exact", True)):
            e = ranges(new[pick], count[pick])
            g = np.repeat(np.flatnonzero(pick), count[pick])
            left = total[g] - mixed[e]
            k = mix(left + salt[g]) if salted == "deleted" else mix(left ^ salt[g])
            more = (count[g] > 1) if on else np.ones(len(g), bool)
            out.append((d[g][more], flag(k[more], np.full(int(more.sum()), on))))
        out.append((d[twice], flag(deleted(total)[twice], np.ones(int(twice.sum()), bool))))
        if short.any():
            i = np.flatnonzero(short)
            long = sets.size[i] - -(-sets.size[i] * sim.num // sim.den) + 1
            e = ranges(sets.first[i], long)
            out.append((np.repeat(i, long), flag(mix(sets.mixed[e] + _C2), np.ones(len(e), bool))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _sizes(sim: Similarity):
    def run(batches):
        for b in batches:
            for i, j, c in chunks(raw(b.column("text"))):
                s = Sets(c, sim)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), b.column("th").slice(i, j - i), *(pa.array(x, pa.int64()) for x in (s.size, s.signature, s.check, s.other()))],
                    ["id", "th", "n", "sig", "check", "other"],
                )

    return run


def _keyed(sim: Similarity, buckets: int, clash: np.ndarray):
    """Rows (bucket, sigs, counts, keys): counts[i] keys (48 bits each) of class sigs[i]. Classes seen in the task count once.

    Keys that very many classes of the task have don't travel with all of them: the task makes their stars and groups
    itself, in rows with a negative bucket, and sends one class only, flagged, to where other tasks' classes meet.
    """

    def packed(sig: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        bucket = ((key >> U(40)) % U(buckets)).astype(np.int64)
        order = np.lexsort((sig, key >> U(2), bucket))
        bucket, sig, key = bucket[order], sig[order], key[order]
        name = (key & U((1 << 48) - 1)) >> U(2) | bucket.astype(U) << U(46)
        new = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        size = np.diff(np.append(new, len(name)))
        out = []
        for at, n in zip(new[size > CROWD].tolist(), size[size > CROWD].tolist()):
            own, first = np.unique(sig[at : at + n], return_index=True)
            probe = np.bitwise_or.reduceat(key[at : at + n] & U(1), first).astype(bool)
            out.append(_star(own, probe, mix(name[at : at + 1])[0]))
            key[at] |= U(2 | int(probe.any()))
        keep = np.ones(len(key), bool)
        keep[ranges(new[size > CROWD] + 1, size[size > CROWD] - 1)] = False
        order = np.flatnonzero(keep)[np.lexsort((sig[keep], bucket[keep]))]
        bucket, sig, key = bucket[order], sig[order], key[order]
        low = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :6]
        new = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (bucket[1:] != bucket[:-1]))))
        count = np.diff(np.append(new, len(sig))).astype(np.uint32)
        cut = np.searchsorted(bucket, ids := np.unique(bucket))
        row = np.searchsorted(new, np.append(cut, len(sig)))
        ends = np.append(cut, len(sig))
        rows = [(int(b), sig[new[row[i] : row[i + 1]]].tobytes(), count[row[i] : row[i + 1]].tobytes(), low[ends[i] : ends[i + 1]].tobytes()) for i, b in enumerate(ids)]
        for i in range(0, len(out), 16):
            kind, x, y, probe = (np.concatenate(c) for c in zip(*out[i : i + 16]))
            rows.append((-1 - int(x[0] & 0xFFFFFFFF), x.tobytes(), y.tobytes(), (kind | probe << 1).astype(np.uint8).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "sigs", "counts", "keys"])

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            for _, _, c in chunks(raw(b.column("text"))):
                s = Sets(c, sim)
                use, own = np.zeros(len(s.size), bool), s.classes(clash)
                for i, sig in enumerate(own.tolist()):
                    if sig not in seen:
                        seen.add(sig)
                        use[i] = True
                d, k = keys(s, use, sim)
                held.append((own[d], k))
                n += len(k)
                if n >= HELD:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*held)))

    return run


def _star(sig: np.ndarray, probe: np.ndarray, name: np.uint64) -> tuple[np.ndarray, ...]:
    """Columns kind, x, y, probe (see _stars) of one key's classes, the least first."""
    pairs, n = np.stack((np.full(len(sig) - 1, sig[0]), sig[1:]), 1), len(sig)
    kind = np.repeat(np.array([0, 1], np.int8), (n - 1, n))
    x = np.concatenate((pairs[:, 0], np.full(n, name.view(np.int64))))
    return kind, x, np.concatenate((pairs[:, 1], sig)), np.concatenate((np.ones(n - 1, bool), probe))


def _stars(table: pa.Table) -> pa.Table:
    """Rows (kind, x, y, probe) of a bucket. Kind 0: pair of a key's least class x with another one, y. Kind 1: class y
    is in group x; groups are keys with three classes or more, and those with equal members are one, but for keys
    that are crowded in some task, whose members are told by several."""
    join = lambda c: b"".join(table.column(c).to_pylist())
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        flags = np.frombuffer(join("keys"), np.uint8)
        return pa.table([pa.array((flags & 1).astype(np.int8)), *(pa.array(np.frombuffer(join(c), np.int64)) for c in ("sigs", "counts")), pa.array(flags > 1)], ["kind", "x", "y", "probe"])
    low = np.zeros((len(flat := np.frombuffer(join("keys"), np.uint8).reshape(-1, 6)), 8), np.uint8)
    low[:, :6] = flat
    key = low.view(U).ravel()
    sig = np.repeat(np.frombuffer(join("sigs"), np.int64), np.frombuffer(join("counts"), np.uint32))
    flags, key = key & U(3), key >> U(2)
    order = np.argsort(key)
    k = key[order]
    same = np.concatenate(([False], k[1:] == k[:-1], [False]))
    order = order[same[1:] | same[:-1] | (flags[order] > 1)]
    key, sig, flags = key[order], sig[order], flags[order]
    order = np.lexsort((sig, key))
    key, sig, flags = key[order], sig[order], flags[order]
    out = [np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    if len(key):
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]))))
        key, sig, flags = key[new], sig[new], np.bitwise_or.reduceat(flags, new)
        probe = (flags & U(1)).astype(bool)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(new, len(key)))
        crowded = np.bitwise_or.reduceat(flags, new) > 1
        live = ((size > 1) & np.logical_or.reduceat(probe, new)) | crowded
        group = np.repeat(np.arange(len(new)), size)
        other = np.ones(len(key), bool)
        other[new] = False
        other &= live[group]
        pairs = np.unique(np.stack((sig[new][group[other]], sig[other]), 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
        # one group for each list of members
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(sig.view(U) * U(2) + probe.astype(U)))))
        name = mix(total[new + size] - total[new] + size.astype(U) * _C1)
        own = mix(key[new] | U(table.column("bucket")[0].as_py()) << U(46))
        name = np.where(crowded, own, name).view(np.int64)
        many = np.flatnonzero(live & ((size > 2) | crowded))
        many = many[np.unique(name[many], return_index=True)[1]]
        rows = ranges(new[many], size[many])
        out = [np.repeat(np.array([0, 1], np.int8), (len(pairs), len(rows))), np.concatenate((pairs[:, 0], np.repeat(name[many], size[many]))), np.concatenate((pairs[:, 1], sig[rows])), np.concatenate((np.ones(len(pairs), bool), probe[rows]))]
    return pa.table([pa.array(c) for c in out], ["kind", "x", "y", "probe"])


def _near(sim: Similarity):
    """Pairs whose sizes and parities don't rule out that they are linked."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            first, second = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
            sizes = np.array([(len(x), len(y)) for x, y in zip(first, second)], np.int64).reshape(n, 2)
            keep = np.minimum(na, nb) * sim.den >= np.maximum(na, nb) * sim.num
            for size in np.unique(sizes, axis=0):
                rows = np.flatnonzero(keep & (sizes == size).all(1))
                if len(rows):
                    x, y = (_folded([p[r] for r in rows], int(size.min())) for p in (first, second))
                    far = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) > sim.differing(na[rows] + nb[rows])
                    keep[rows[far]] = False
            yield batch.select(["a", "b", "nb"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, parity: DataFrame, sim: Similarity) -> DataFrame:
    """Those of pairs (a, b) whose texts are linked. texts: (sig, text), parity: (sig, n, parity)."""
    of = lambda c: parity.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "pa", "pb")
    near = materialise(near.mapInArrow(_near(sim), "a long, b long, nb long"), bulk=F.sum("nb"))
    bulk = near.seen["bulk"] or 0
    groups = max(1, -(-int(bulk) * 8 // GROUP_BYTES))
    parts = near.groupBy("a").agg(F.ceil(F.count("*") / CENTRE).alias("parts"))
    asked = near.join(parts, "a").select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("sig"))
    asked = asked.union(asked.select("centre", "part", F.col("centre").alias("sig")).distinct())
    asked = materialise(asked.withColumn("place", F.pmod(F.xxhash64("centre", "part"), F.lit(groups))))

    def compare(table: pa.Table) -> pa.Table:
        centre, part, sig = (table.column(c).to_numpy() for c in ("centre", "part", "sig"))
        order = np.lexsort((sig != centre, part, centre))  # each centre's own text comes before its members
        texts_ = raw(table.column("text").combine_chunks())
        a: list[int] = []
        b: list[int] = []
        own, shingles = np.zeros(0, U), set()
        for i, j, c in chunks([texts_[o] for o in order]):
            s = Sets(c, sim)
            for r in range(i, j):
                o, e = order[r], s.of(r - i)
                if sig[o] == centre[o]:
                    own, shingles, text = e.copy(), set(), texts_[o]
                elif sim.linked(len(np.intersect1d(own, e, assume_unique=True)), len(own), len(e)):
                    shingles = shingles or _shingles(text, sim.words)
                    other = _shingles(texts_[o], sim.words)
                    if sim.linked(len(shingles & other), len(shingles), len(other)):
                        a.append(centre[o])
                        b.append(sig[o])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = materialise(texts.join(_small(asked), "sig").groupBy("place").applyInArrow(compare, "a long, b long"))
    discard(near, asked)
    return out


def _shingles(text: bytes, k: int) -> set[bytes]:
    """The set itself, as bytes."""
    words = text.translate(_LOWER).split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows: then what it is joined with stays in place."""
    return F.broadcast(table) if table.seen["n"] <= BROADCAST else table


def _spanning(groups: DataFrame, component: DataFrame) -> DataFrame:
    """(g, sig, probe, component, alone, c) of the groups whose members lie in different components; alone are those without
    a link, c is the number of members."""
    member = groups.select("g", "sig", "probe").join(component.withColumnRenamed("node", "sig"), "sig", "left")
    member = member.select("g", "sig", "probe", F.coalesce("component", "sig").alias("component"), F.col("component").isNull().alias("alone"))
    member = materialise(member)
    over = member.groupBy("g").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.count("*").alias("c")).filter("a <> z")
    over = materialise(over.select("g", "c"))
    out = materialise(member.join(_small(over), "g"))
    discard(member, over)
    return out


def _other_centres(spanning: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of other centres of groups with one member of each other component that they meet there.

    Centres are least by a hash that few groups share, so that a member of many groups meets few of them.
    """
    order = F.xxhash64("sig", F.pmod("g", F.lit(CENTRES)), F.lit(turn))
    centre = materialise(spanning.groupBy("g").agg(F.min(F.struct(order.alias("order"), "sig", "component", "probe")).alias("m")))
    met = spanning.join(_small(centre), "g").filter("component <> m.component and (probe or m.probe)")
    one = met.groupBy(F.col("m.sig").alias("centre"), "component").agg(F.min(F.struct(F.xxhash64("sig", F.lit(turn)).alias("order"), "sig")).alias("m"))
    return one.select(F.least("m.sig", "centre").alias("a"), F.greatest("m.sig", "centre").alias("b")).distinct()


def _parities(sim: Similarity):
    """(sig, n, parity): bit b says whether the set has an odd number of elements whose hash is b modulo the bits."""

    def run(batches):
        for batch in batches:
            for i, j, c in chunks(raw(batch.column("text"))):
                s, out = Sets(c, sim), []
                for k in range(j - i):
                    bits = 1 << max(6, int(SHARP * s.size[k] - 1).bit_length())
                    odd = np.bincount((s.mixed[s.first[k] : s.first[k + 1]] & U(bits - 1)).astype(np.int64), minlength=bits) & 1
                    out.append(np.packbits(odd.astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("sig").slice(i, j - i), pa.array(s.size, pa.int64()), pa.array(out, pa.binary())], ["sig", "n", "parity"])

    return run


def _folded(parities: list[bytes], size: int) -> np.ndarray:
    """Rows of words of size bytes: parity modulo half the bits is the sum of both halves."""
    out = np.zeros((len(parities), size), np.uint8)
    for i, p in enumerate(parities):
        out[i] = np.frombuffer(p, np.uint8) if len(p) == size else np.bitwise_xor.reduce(np.frombuffer(p, np.uint8).reshape(-1, size), axis=0)
    return out.view(U)


def _across(spanning: DataFrame, parity: DataFrame, sim: Similarity, nearest: bool) -> DataFrame:
    """Pairs (a, b) of each group whose members lie in different components and one of which probes; with nearest, of the
    pairs of two components in a block only one with the least distance of parities. Without, as comes after it, two
    classes that are still alone make no pair: they had one.

    The members of a group are dealt into blocks, and each pair of blocks is compared in memory. Two sets can't be
    linked if their parities differ in more bits than linked sets differ in elements, so hardly any pair that isn't
    near the similarity leaves a block. Two members that probe in the same least group, or greatest one, leave that only,
    and not each of the many that near ones share.
    """
    home = spanning.filter("probe").groupBy("sig").agg(F.min("g").alias("least"), F.max("g").alias("most"))
    rows = spanning.join(parity.join(home, "sig", "left"), "sig").withColumns({c: F.coalesce(c, "g") for c in ("least", "most")})
    rows = rows.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    total = rows.agg(F.sum("blocks")).first()[0] or 0
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    # a member goes to every pair of blocks that has its own
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", "sig", "probe", "n", "component", "alone", "least", "most", "parity", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("g", "i", "j"), F.lit(1 + int(total) // PLACE)))

    def cross(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "j", "sig", "probe", "n", "component", "alone", "least", "most", "own")}
        order = np.lexsort((t["j"], t["i"], t["g"]))
        t = {c: v[order] for c, v in t.items()}
        parities = table.column("parity").to_pylist()
        new = np.flatnonzero(np.concatenate(([True], (t["g"][1:] != t["g"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1]))))
        found = [np.zeros((0, 2), np.int64)]

        def one_each(a: np.ndarray, b: np.ndarray, far: np.ndarray, part: np.ndarray) -> np.ndarray:
            low, high = np.minimum(part[a], part[b]), np.maximum(part[a], part[b])
            order = np.lexsort((far, high, low))
            low, high = low[order], high[order]
            return order[np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))] if len(order) else order

        for s, e in zip(new, np.append(new[1:], len(order))):
            sig, n, part, probe, alone, least, most = (t[c][s:e] for c in ("sig", "n", "component", "probe", "alone", "least", "most"))
            own = [parities[o] for o in order[s:e]]
            bits = _folded(own, min(map(len, own)))
            left, right = (np.flatnonzero(t["own"][s:e] == t[c][s]) for c in ("i", "j"))
            ok = (part[left][:, None] != part[right]) & (probe[left][:, None] | probe[right])
            ok &= np.minimum(n[left][:, None], n[right]) * sim.den >= np.maximum(n[left][:, None], n[right]) * sim.num
            if not nearest:
                ok &= ~(alone[left][:, None] & alone[right])
            x, y = np.nonzero(ok)
            for k in range(0, len(x), 1 << 14):
                a, b = left[x[k : k + (1 << 14)]], right[y[k : k + (1 << 14)]]
                far = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
                home = np.where(least[a] == least[b], least[a], np.where(most[a] == most[b], most[a], t["g"][s]))
                near = (far <= sim.differing(n[a] + n[b])) & (home == t["g"][s])
                a, b, far = a[near], b[near], far[near]
                if nearest:
                    one = one_each(a, b, far, part)
                    a, b = a[one], b[one]
                found.append(np.stack((sig[a], sig[b]), 1))
        pair = np.concatenate(found)
        pair.sort(axis=1)
        pair = np.unique(pair, axis=0)
        return pa.table([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return rows.groupBy("place").applyInArrow(cross, "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """Near-duplicate classes: documents whose shingle sets reach the similarity are linked.

    Takes doc_id and text; A-Z are lower-cased, words are runs of anything but ASCII white space. Returns per
    row id, th (see keyed()), doc_id, n_shingles, component_id, the least doc_id reachable by links, itself
    included, and component, which tells classes apart where doc_id is null or repeated. Fewer words than a shingle has make one shingle; null, empty and blank texts have none and are
    linked with nothing. Rows with equal texts are linked; a null doc_id counts as the least id and is
    given as null; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs, sim = keyed(docs), replace(sim, seed=new_seed())
    info = materialise(docs.mapInArrow(_sizes(sim), "id long, th long, n long, sig long, check long, other long"), bulk=F.sum("n"))
    bulk = info.seen["bulk"] or 0
    # chance alone makes n * n / 2**65 such signatures for n classes: 17 for 25 billion
    clash = [r["sig"] for r in info.groupBy("sig").agg(F.min("check").alias("a"), F.max("check").alias("z")).filter("a <> z").collect()]
    if clash:
        info = info.withColumn("sig", F.when(F.col("sig").isin(clash), F.col("other")).otherwise(F.col("sig")))
    classes = info.filter("n > 0").groupBy("sig").agg(F.min("n").alias("n"), F.min(F.struct("id", "th")).alias("r"))
    buckets = max(1, -(-int(bulk) * 2 // (3 * BUCKET)))
    sent = docs.select("text").mapInArrow(_keyed(sim, buckets, np.array(clash, np.int64)), "bucket long, sigs binary, counts binary, keys binary")
    met = materialise(sent.groupBy("bucket").applyInArrow(_stars, "kind byte, x long, y long, probe boolean").distinct())

    pairs = met.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(classes, "sig").select("sig", F.col("r.id").alias("id"), F.col("r.th").alias("th")))
    texts = materialise(docs.join(_small(asked), ["id", "th"]).dropDuplicates(["sig"]).select("sig", "text"))
    discard(asked)
    parity = materialise(texts.mapInArrow(_parities(sim), "sig long, n long, parity binary"))
    component = materialise(components(_verified(pairs, texts, parity, sim)))
    groups = met.filter("kind = 1").select(F.col("x").alias("g"), F.col("y").alias("sig"), "probe").distinct()
    done = pairs
    turn = 0
    while turn < ROUNDS + 2:
        groups = spanning = _spanning(groups, component)  # components only grow, so other groups are done
        if not spanning.seen["n"]:
            break
        more = _other_centres(spanning, turn) if turn < ROUNDS else _across(spanning, parity, sim, turn == ROUNDS)
        more, turn = materialise(more.join(done, ["a", "b"], "left_anti")), turn + 1
        if not more.seen["n"]:
            continue
        done = done.union(more)
        links = _verified(more, texts, parity, sim)
        if links.seen["n"]:
            component = materialise(joined(component, links))
        if turn < ROUNDS and links.seen["n"] * PAYS < more.seen["n"]:
            turn = ROUNDS
    named = info.join(component.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = named.filter("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least, "component", "left")
    out = materialise(named.select("id", "th", doc_id(), F.col("n").alias("n_shingles"), F.nullif(F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")), F.lit(NO_ID)).alias("component_id"), "component"))
    discard(texts, parity, met)
    return out
