"""Search for windows of W units (bytes or words) that occur more than once, without comparing documents pairwise.

Each window is assigned to its anchor: the leftmost of its k-unit grams with the least hash. Equal windows
have equal anchors, so a window can only repeat where its anchor does. The windows that share one anchor
occurrence are consecutive (a run); the units they cover are the run's context. The steps:

1. one pass over the texts gives every document's anchor hashes; the counts per hash are combined map-side;
2. documents with repeated anchors give their runs as (anchor, digest of the context, place). An aggregate keeps
   one representative of each distinct context and notes whether there are more occurrences of it;
3. the representatives of an anchor go to its shard, where a matcher given by the operator decides which windows
   are repeats: for the representative and for the other occurrences of its context. Nothing is removed that the
   matcher hasn't found;
4. an anchor with more than HOT contexts is dealt over several shards by digest. Shards that have windows in
   common (by 128-bit hashes) send each other the units under them, and the matcher merges those with its own;
5. the decisions go back to all occurrences. Keys with very many of them are salted.

Digests have 128 bits and a seed that is drawn for each run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import discard, keyed, materialise, ship
from ._text import _MASK, SPACED, Chunk, U, chain, chunks, factors, grams, lists, mix, ranges, raw, slices

#: Distinct contexts of one anchor in a shard, bytes of contexts in a shard, and rows of a key that aren't salted.
HOT, SHARD_BYTES, ROWS = 4096, 2 << 20, 2048


@dataclass(frozen=True)
class Windows:
    """words: units are words, else bytes. size: units in a window. gram: units in an anchor."""

    words: bool
    size: int
    gram: int
    seed: int = 1


def _byte_grams(eight: np.ndarray, n: int, k: int, seed: int) -> np.ndarray:
    """Hash of the k bytes from each of n places on."""
    n, f = max(0, n - k + 1), factors(seed)
    if k < 8:
        return mix((eight[:n] & _MASK[k]) ^ f[-1])
    values, out = mix(eight ^ f[-1]), np.zeros(n, U)
    for j in (*range(0, k - 8, 8), k - 8):
        out += values[j : j + n] * f[j]
    return mix(out)


class Runs:
    """Anchors of a chunk. Per run: doc, at (first window's start), count (windows), anchor."""

    def __init__(self, chunk: Chunk, w: Windows):
        self.chunk, self.w = chunk, w
        if w.words:
            chunk.words(SPACED, seed=w.seed)
            units, self.lo, self.hi = len(chunk.hash), chunk.lo, chunk.hi
            hashes = grams(chunk.hash, w.gram, w.seed)
        else:
            units, self.lo, self.hi = len(chunk.data), chunk.at, chunk.at + chunk.size
            hashes = _byte_grams(chunk.eight, units, w.gram, w.seed)
        n = max(0, units - w.size + 1)
        least = _least(hashes, w.size - w.gram + 1)[:n]
        valid = np.zeros(units + 1, np.int32)
        long = self.hi - self.lo >= w.size
        np.add.at(valid, self.lo[long], 1)
        np.add.at(valid, self.hi[long] - w.size + 1, -1)
        valid = np.cumsum(valid)[:n] > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        self.at = np.flatnonzero(new)
        last = valid.copy()
        last[:-1] &= ~valid[1:] | new[1:]
        self.count = np.flatnonzero(last) - self.at + 1
        self.anchor = hashes[least[self.at]]
        self.doc = np.searchsorted(self.lo, self.at, "right") - 1

    def digests(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the contexts of the runs k."""
        return _digests(self.chunk, self.w, self.at[k], self.count[k] + self.w.size - 1)


def _digests(c: Chunk, w: Windows, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of size units from each start on."""
    out = []
    for salt in factors(w.seed)[-4:-2]:
        if w.words:
            out.append(chain(c.hash, start, size, salt))
        elif w.size < 8:
            out.append(chain(c.data.astype(U), start, size, salt))
        else:
            out.append(mix(chain(c.eight, start, size // 8, salt, 8) ^ c.eight[start + size - 8]) + size.astype(U))
    return out[0], out[1]


def _least(hashes: np.ndarray, span_of: int) -> np.ndarray:
    """For each place the place of the leftmost least of span_of hashes from there (32 leading bits count)."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    rows = -(-n // span_of) + 1
    value = np.full(rows * span_of, ~U(0), U)
    value[:n] = (hashes & ~U(0xFFFFFFFF)) | np.arange(n, dtype=U)
    block = value.reshape(rows, span_of)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[span_of - 1 : span_of - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)


def content(text: bytes, w: Windows) -> bytes:
    return b" ".join(text.split()) if w.words else text


def _scan(w: Windows):
    def run(batches):
        for b in batches:
            ids, ths = b.column("id").to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False)
            for i, j, c in chunks(raw(b.column("text"))):
                r = Runs(c, w)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i:j]), pa.array(ths[i:j]), pa.array(r.hi - r.lo, pa.int64()),
                        pa.array([hashlib.sha256(content(t, w)).hexdigest() for t in c.texts]),
                        lists(r.anchor.view(np.int64), np.bincount(r.doc, minlength=j - i), pa.int64()),
                    ],
                    ["id", "th", "n", "sha", "anchors"],
                )

    return run


def _contexts(w: Windows):
    """Runs of each document whose anchors are among its column anchors."""

    def run(batches):
        for b in batches:
            ids, ths = b.column("id").to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False)
            listed = b.column("anchors")
            for i, j, c in chunks(raw(b.column("text"))):
                r, part = Runs(c, w), listed.slice(i, j - i)
                own = part.flatten().to_numpy(zero_copy_only=False).view(U)
                of = np.repeat(np.arange(j - i), part.value_lengths().to_numpy(zero_copy_only=False))
                salt = lambda doc: mix(doc.astype(U) + U(1))  # noqa: E731  a document's own list counts only
                k = np.flatnonzero(np.isin(r.anchor ^ salt(r.doc), own ^ salt(of)))
                d, digests = r.doc[k], r.digests(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[i + d], ths[i + d], r.anchor[k].view(np.int64), *(x.view(np.int64) for x in digests), r.at[k] - r.lo[d], r.count[k].astype(np.int64))],
                    ["id", "th", *KEY, "at", "count"],
                )

    return run


KEY = ["anchor", "d1", "d2"]
_PICK = ["shard", "hot", *KEY, "more", "count"]
_SNIPPET = "shard long, hot boolean, anchor long, d1 long, d2 long, more boolean, count long, id long, part binary"


def _snippets(w: Windows):
    """The units under each picked run, words joined by a space."""

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for b in slices(batches):
            out: list[tuple] = []
            for i, text, picks in zip(b.column("id").to_pylist(), raw(b.column("text")), b.column("picks").to_pylist()):
                units = text.split() if w.words else text
                for p in picks:
                    part = units[p["at"] : p["at"] + p["count"] + w.size - 1]
                    out.append((*(p[c] for c in _PICK), i, b" ".join(part) if w.words else part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [*_PICK, "id", "part"])

    return run


class Shard:
    """Contexts one behind the other, in ascending order of id.

    units, and per context first, count (windows), id, more (it occurs again: under a greater id if ids count);
    start: places of all window starts, of: their context, base: each context's first window.
    Contexts from other shards have guest set.
    """

    def __init__(self, table: pa.Table, w: Windows, guests: pa.Table | None = None):
        own = table.select([*KEY, "more", "count", "id", "part"])
        guest = np.zeros(own.num_rows, bool)
        if guests is not None and guests.num_rows:
            n = guests.num_rows
            more = [pa.nulls(n, pa.int64())] * 3 + [pa.array(np.zeros(n, bool)), *(guests.column(c).combine_chunks() for c in ("count", "id", "part"))]
            own = pa.concat_tables([own, pa.table(more, schema=own.schema)])
            guest = np.append(guest, np.ones(n, bool))
        order = np.argsort(own.column("id").to_numpy(), kind="stable")
        self.table, self.guest = own, guest[order]
        self.row = order  # of the table
        self.id, self.count, self.more = (own.column(c).to_numpy()[order] for c in ("id", "count", "more"))
        parts = own.column("part").to_pylist()
        self.chunk = c = Chunk([parts[i] for i in order.tolist()])
        if w.words:
            c.words(SPACED, seed=w.seed)
            self.units, self.first = c.exact(), c.lo
        else:
            self.units, self.first = c.data, c.at
        self.base = np.cumsum(self.count) - self.count
        self.start, self.of = ranges(self.first, self.count), np.repeat(np.arange(len(self.first)), self.count)


#: (context, from, to, kind) of repeats: units of a context relative to its beginning. kind OWN: for the
#: representative, REST: for the context's other occurrences.
Repeats = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Matcher = Callable[[Shard, Windows], Repeats]
OWN, REST = 0, 1
_SPAN = "array<struct<a: long, z: long>>"
_DECIDED = f"anchor long, d1 long, d2 long, least long, own {_SPAN}, rest {_SPAN}"


def runs(s: Shard, hit: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to) of the units under the hit windows (a mask along s.start)."""
    new, last = hit.copy(), hit.copy()
    inner = s.of[1:] == s.of[:-1]
    new[1:] &= ~(hit[:-1] & inner)
    last[:-1] &= ~(hit[1:] & inner)
    a, z = np.flatnonzero(new), np.flatnonzero(last)
    c = s.of[a]
    return c, a - s.base[c], z - s.base[c] + w.size


def _decided(s: Shard, found: Repeats) -> pa.Table:
    """A row for each context of this shard with repeats."""
    context, a, z, kind = found
    own = ~s.guest[context]
    context, a, z, kind = context[own], a[own], z[own], kind[own]
    n = len(s.id)
    order = np.lexsort((a, context, kind))
    context, a, z, kind = context[order], a[order], z[order], kind[order]
    some = np.flatnonzero(np.bincount(context, minlength=n))
    columns = []
    for k in (OWN, REST):
        count = np.bincount(context[kind == k], minlength=n)[some]
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
        columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x[kind == k], pa.int64()) for x in (a, z)], ["a", "z"])))
    keys = s.table.select(KEY).take(pa.array(s.row[some]))
    return pa.table([*keys.columns, pa.array(s.id[some], pa.int64()), *columns], [*KEY, "least", "own", "rest"])


@dataclass
class Found:
    """every: (id, th, n, sha) of all documents. texts: (id, th, text, anchors) of those with repeated anchors.
    spans: (id, th, spans) of the units under repeated windows; they may overlap."""

    every: DataFrame
    texts: DataFrame
    spans: DataFrame


def salted(many: DataFrame, one: DataFrame, keys: list[str], sizes: DataFrame, size: str, total: int, by: list[str]) -> DataFrame:
    """many joined with one on keys. sizes tells how many rows of many a key has (total together); the rows of a key
    with very many are dealt over several tasks by a hash of the columns `by`. There can't be more than 100,000 such keys,
    so the list of them is broadcast."""
    limit = max(ROWS, total // 100_000)
    hot = F.broadcast(sizes.filter(F.col(size) > limit).select(*keys, F.ceil(F.col(size) / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    many = many.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    one = one.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return many.join(one, [*keys, "_part"]).drop("_part")


def find(docs: DataFrame, w: Windows, match: Matcher, earlier: bool) -> Found:
    """Windows of w.size units that occur elsewhere: in a document with a smaller id if earlier, else anywhere.

    match(shard, w) tells which units of a shard's contexts are repeats; of guests it only takes notice.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = keyed(docs)
    every = materialise(docs.mapInArrow(_scan(w), "id long, th long, n long, sha string, anchors array<long>"))
    rows = every.select("id", "th", F.explode("anchors").alias("anchor"))
    seen = rows.groupBy("anchor").agg(F.count("*").alias("c"), F.min("id").alias("a"), F.max("id").alias("z"))
    repeated = materialise(seen.filter("a < z" if earlier else "c > 1").select("anchor", "c"), total=F.sum("c"))
    total = repeated.seen["total"] or 0
    once = every.select("id", "th", F.explode(F.array_distinct("anchors")).alias("anchor"))
    mine = salted(once, repeated.select("anchor"), ["anchor"], repeated, "c", total, ["id", "th"])
    mine = materialise(mine.groupBy("id", "th").agg(F.collect_set("anchor").alias("anchors")))
    texts = materialise(docs.join(mine, ["id", "th"]))
    found = materialise(texts.mapInArrow(_contexts(w), "id long, th long, anchor long, d1 long, d2 long, at long, count long"))
    discard(mine, repeated)

    same = found.groupBy(*KEY).agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "at", "count")).alias("r"), F.max("id").alias("z"))
    more = F.col("z") > F.col("r.id") if earlier else F.col("c") > 1
    same = materialise(same.select(*KEY, "c", "r.*", more.alias("more")), total=F.sum("c"))
    hot = materialise(same.groupBy("anchor").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > HOT))
    few = F.broadcast(hot) if hot.seen["n"] <= 100_000 else hot  # then no anchor's contexts are brought together
    picked = materialise(same.join(few, "anchor", "left"), units=F.sum(F.col("count") + w.size))
    any_hot = hot.seen["n"] > 0
    shards = max(1, -(-int(picked.seen["units"] or 0) * (6 if w.words else 1) // SHARD_BYTES))
    part = F.pmod(F.xxhash64("d1", "d2"), F.ceil(F.col("contexts") / HOT).cast("long"))
    shard = F.when(F.col("contexts").isNotNull(), F.xxhash64("anchor", part)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    picks = picked.select("id", "th", F.struct(shard.alias("shard"), F.col("contexts").isNotNull().alias("hot"), *KEY, "more", "at", "count").alias("pick"))
    picks = picks.groupBy("id", "th").agg(F.collect_list("pick").alias("picks"))
    snippets = texts.select("id", "th", "text").join(picks, ["id", "th"]).dropDuplicates(["id", "th"]).mapInArrow(_snippets(w), _SNIPPET)
    if any_hot:
        snippets = materialise(snippets)

    def cold(table: pa.Table) -> pa.Table:
        s = Shard(table, w)
        return _decided(s, match(s, w))

    decided = snippets.filter("not hot").groupBy("shard").applyInArrow(cold, _DECIDED)
    if any_hot:
        decided = decided.union(_hot(snippets.filter("hot"), w, match, earlier))
    decided = materialise(decided)
    discard(picked, hot)
    # occurrences under the representative's id share its fate, wherever they are
    total = same.seen["total"] or 0
    out = salted(found, decided, KEY, same, "c", total, ["id", "th", "at"])
    mine = F.when(F.col("id") == F.col("least"), F.col("own")).otherwise(F.col("rest")) if earlier else F.col("own")
    out = out.select("id", "th", F.transform(mine, lambda x: F.struct((F.col("at") + x.a).alias("at"), (F.col("at") + x.z).alias("to"))).alias("spans"))
    out = materialise(out.filter("size(spans) > 0").groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    discard(found, same, decided, *([snippets] if any_hot else []))
    return Found(every.drop("anchors"), texts, out)


def _hot(snippets: DataFrame, w: Windows, match: Matcher, earlier: bool) -> DataFrame:
    """Decisions in shards that share their anchors with other shards.

    Each shard tells its distinct windows. Of those that several have, the shard with the least id (and so all that can
    be `earlier`) sends the units to the others, in runs; if ids don't count, another one sends them to that shard.
    """

    def windows(table: pa.Table) -> pa.Table:
        s = Shard(table, w)
        k = _digests(s.chunk, w, s.start, np.full(len(s.start), w.size))
        order = np.lexsort((np.arange(len(s.start)), *k))  # contexts ascend by id
        k1, k2 = k[0][order], k[1][order]
        new = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
        shard = np.full(len(new), table.column("shard")[0].as_py())
        return pa.table([pa.array(x, pa.int64()) for x in (shard, k1[new].view(np.int64), k2[new].view(np.int64), s.id[s.of[order[new]]])], ["shard", "k1", "k2", "least"])

    own = materialise(snippets.groupBy("shard").applyInArrow(windows, "shard long, k1 long, k2 long, least long"))
    ends = [f(F.struct("least", "shard")).alias(a) for f, a in ((F.min, "first"), (F.max, "last"))]
    common = materialise(own.groupBy("k1", "k2").agg(F.count("*").alias("c"), *ends).filter("c > 1").select("k1", "k2", F.col("first.shard").alias("first"), F.col("last.shard").alias("last")))
    given = common.select(F.col("first").alias("shard"), "k1", "k2", F.lit(None).cast("long").alias("only"))
    if not earlier:
        given = given.union(common.select(F.col("last").alias("shard"), "k1", "k2", F.col("first").alias("only")))

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["run", "shard", "only", "id", "count", "part", "k"]
        schema = pa.schema(list(zip(names, [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))])))
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        s, shard, rows = Shard(left, w), left.column("shard")[0].as_py(), []
        place: dict[tuple[int, int], int] = {}
        k1, k2 = (x.view(np.int64).tolist() for x in _digests(s.chunk, w, s.start, np.full(len(s.start), w.size)))
        for i, k in enumerate(zip(k1, k2)):
            place.setdefault(k, i)
        units = (lambda a, z: b" ".join(s.chunk.word(i) for i in range(a, z))) if w.words else (lambda a, z: s.chunk.buffer[a:z])
        wanted = zip(*(right.column(c).to_pylist() for c in ("only", "k1", "k2")))
        wanted = sorted((o is not None, o or 0, place[a, z]) for o, a, z in wanted)
        i = 0
        while i < len(wanted):
            one, to, at = wanted[i]
            n = 1
            while i + n < len(wanted) and wanted[i + n] == (one, to, at + n) and s.of[at + n] == s.of[at]:
                n += 1
            a = int(s.start[at])
            run = int.from_bytes(hashlib.blake2b(f"{shard} {one} {to} {at}".encode(), digest_size=8).digest(), "little", signed=True)
            rows.append((run, shard, to if one else None, int(s.id[s.of[at]]), n, units(a, a + n + w.size - 1), [{"k1": k1[j], "k2": k2[j]} for j in range(at, at + n)]))
            i += n
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    sent = materialise(snippets.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(give, "run long, shard long, only long, id long, count long, part binary, k array<struct<k1: long, k2: long>>"))
    keys = sent.select("run", F.col("shard").alias("giver"), "only", F.explode("k").alias("k")).select("run", "giver", "only", "k.*")
    to = keys.join(own.select("shard", "k1", "k2"), ["k1", "k2"]).filter("shard <> giver and (only is null or only = shard)").select("shard", "run").distinct()
    guests = to.join(sent.select("run", "id", "count", "part"), "run")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left, w, right)
        return _decided(s, match(s, w))

    out = materialise(snippets.groupBy("shard").cogroup(guests.groupBy("shard")).applyInArrow(both, _DECIDED))
    discard(own, common, sent)
    return out


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def removed(found: Found, w: Windows, keep_text: bool) -> DataFrame:
    """(id, th, n, n_removed, n_spans, sha) of all documents, and, of those that lose units, the kept text if keep_text."""

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            rows = []
            for text, spans in zip(raw(b.column("text")), b.column("spans").to_pylist()):
                units, gone, at, kept = (text.split() if w.words else text), covered([(s["at"], s["to"]) for s in spans]), 0, []
                for a, z in gone:
                    kept.extend(units[at:a]) if w.words else kept.append(units[at:a])
                    at = z
                kept.extend(units[at:]) if w.words else kept.append(units[at:])
                rest = (b" " if w.words else b"").join(kept)
                rows.append((len(units), sum(z - a for a, z in gone), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if keep_text else None))
            cols = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), *(pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))],
                ["id", "th", "n", "n_removed", "n_spans", "sha", "kept"],
            )

    schema = "id long, th long, n long, n_removed long, n_spans long, sha string, kept string"
    lost = found.texts.select("id", "th", "text").join(found.spans, ["id", "th"]).mapInArrow(cut, schema)
    kept = found.every.join(found.spans.select("id", "th"), ["id", "th"], "left_anti")
    zero = F.lit(0).cast("long")
    return lost.unionByName(kept.select("id", "th", "n", zero.alias("n_removed"), zero.alias("n_spans"), "sha", F.lit(None).cast("string").alias("kept")))
