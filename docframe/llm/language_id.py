"""Language ID with hyperdimensional profiles.

Each letter, of whatever script, has a random vector of +1 and -1. An n-gram's vector is the product of its letters'
vectors, each rotated by its place; a text's vector is the sum over its n-grams, a language's prototype the sum over all its
learning texts. The language whose prototype has the greatest cosine with the text is predicted.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import doc_id, keyed, ship
from ._text import U, mix, raw

#: Components of a vector and letters of an n-gram.
DIM, N = 1024, 3
#: Bytes and documents taken together, n-grams whose vectors are made at once, n-grams that a task counts before it
#: bundles them, and languages at most (a column with more values isn't one of languages).
CHUNK, MOST, SLICE, HELD, LANGUAGES = 1 << 20, 400, 1 << 13, 1 << 18, 10_000
GAP = 0x20
_codes: list[np.ndarray] = []


def _letter(point: int) -> int:
    """0 for what isn't a letter, else the letter's code point in lower case."""
    c = chr(point)
    return ord(c.lower()[0]) if c.isalpha() else 0


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram) of every n-gram: 21 bits a letter. Between words, before and behind a text stands one gap, as a
    letter."""
    if not _codes:
        _codes.append(np.array([_letter(p) for p in range(1 << 16)], np.int32))
    strings = [f"\n{t.decode('utf-8', 'replace')}\n" for t in texts]
    points = np.frombuffer("".join(strings).encode("utf-32-le", "replace"), "<u4")
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, strings), np.int64, len(strings)))
    code = _codes[0][np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        code[i] = _letter(int(points[i]))
    keep = code > 0
    keep[1:] |= (code[:-1] > 0) | (doc[1:] != doc[:-1])
    keep[:1] = True
    code, doc = np.where(code > 0, code, GAP)[keep].astype(np.int64), doc[keep]
    if len(code) < N:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    inside = doc[: len(doc) - N + 1] == doc[N - 1 :]
    gram = np.zeros(len(code) - N + 1, np.int64)
    for j in range(N):
        gram = gram << 21 | code[j : len(code) - N + 1 + j]
    return doc[: len(gram)][inside], gram[inside]


def letters(points: np.ndarray) -> np.ndarray:
    """The random vector of each letter: bits drawn with the code point as the seed."""
    words = np.arange(DIM // 64, dtype=np.uint64)
    drawn = mix(mix(points.astype(np.uint64)[:, None] * U(0xA0761D6478BD642F) + words) + words)
    return np.where(np.unpackbits(drawn.view(np.uint8), axis=1), 1, -1).astype(np.int8)


def vectors(gram: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each n-gram: its letters' vectors, each rotated by its place, bound by a product."""
    out = np.ones((len(gram), DIM), np.int8)
    for j in range(N):
        point, of = np.unique(gram >> 21 * (N - 1 - j) & 0x1FFFFF, return_inverse=True)
        out *= np.roll(letters(point), N - 1 - j, axis=1)[of]
    return out


def _parts(texts: list[bytes | None]):
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= CHUNK or i + 1 - first == MOST or i + 1 == len(texts):
            yield first, i + 1, [x or b"" for x in texts[first : i + 1]]
            first, total = i + 1, 0


def bundles(row: np.ndarray, gram: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the vectors of each row's n-grams."""
    used, of = np.unique(gram, return_inverse=True)
    order = np.argsort(of, kind="stable")
    row, of = row[order].astype(np.int64), of[order]
    out = np.zeros((rows, DIM), np.float32)
    for first in range(0, len(used), SLICE):
        a, z = np.searchsorted(of, (first, first + SLICE))
        width = min(SLICE, len(used) - first)
        counts = np.bincount(row[a:z] * width + of[a:z] - first, minlength=rows * width).astype(np.float32).reshape(rows, width)
        out += counts @ vectors(used[first : first + SLICE]).astype(np.float32)
    return out


def _learnt(batches):
    """(lang, vector): the sums of a task's learning texts."""
    sums: dict[str, np.ndarray] = {}
    counts: dict[str, Counter] = {}
    held = 0

    def bundle():
        for name, own in counts.items():
            gram, n = np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.float64, len(own))
            total = sums.setdefault(name, np.zeros(DIM, np.int64))
            for i in range(0, len(gram), SLICE):  # whole numbers below 2**53, so exact
                total += (n[i : i + SLICE] @ vectors(gram[i : i + SLICE]).astype(np.float64)).astype(np.int64)
        counts.clear()

    for b in batches:
        langs = b.column("lang").to_pylist()
        for i, j, texts in _parts(raw(b.column("text"))):
            doc, gram = grams(texts)
            names, which = np.unique(np.array(langs[i:j], object), return_inverse=True)
            for k, name in enumerate(names):
                used, n = np.unique(gram[which[doc] == k] if len(doc) else gram, return_counts=True)
                own = counts.setdefault(name, Counter())
                held -= len(own)
                for g, c in zip(used.tolist(), n.tolist()):
                    own[g] += c
                held += len(own)
            if held > HELD:
                bundle()
                held = 0
            if len(sums) > LANGUAGES:
                raise ValueError(f"lang has more than {LANGUAGES} values")
    bundle()
    for name, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "vector"])


def prototypes(docs: DataFrame) -> DataFrame:
    """(lang, vector) learnt from text and lang of all rows; rows with null lang are left out."""
    ship(docs.sparkSession)
    rows = docs.select("lang", "text").filter("lang is not null").mapInArrow(_learnt, "lang string, vector array<long>")
    # sums of whole numbers, so their order doesn't matter
    rows = rows.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("vector"))
    return rows.select("lang", F.col("vector.x").cast("array<double>").alias("vector"))


def predict(docs: DataFrame, learnt: DataFrame) -> DataFrame:
    """(id, th, lang_pred, score) for docs as keyed() gives them."""
    rows = sorted(learnt.limit(LANGUAGES + 1).collect(), key=lambda r: r["lang"])  # one row for each language
    if len(rows) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    names = [r["lang"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], np.float32).reshape(len(rows), DIM)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    held = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches):
        names, matrix = held.value
        for b in batches:
            for i, j, texts in _parts(raw(b.column("text"))):
                doc, gram = grams(texts)
                bundle = bundles(doc, gram, j - i)
                size = np.linalg.norm(bundle, axis=1)
                cosine = bundle @ matrix.T / np.maximum(size, 1e-9)[:, None]
                known = (np.bincount(doc, minlength=j - i) > 0) & (len(names) > 0)
                best = cosine.argmax(1) if names else np.zeros(j - i, int)
                score = np.where(known, np.clip(cosine.max(1) if names else 0, 0, 1), 0.0).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array([names[k] if ok else "und" for k, ok in zip(best, known)], pa.string()), pa.array(score)],
                    ["id", "th", "lang_pred", "score"],
                )

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Predicted language of each whole text.

    Takes doc_id, text and lang. Learns from all rows with a lang whose crc32(doc_id as text) mod 3 isn't 1 (a
    null doc_id counts as empty text there). Returns doc_id, held_out, lang_pred and score, the cosine with the
    prototype (0 where negative). lang_pred is `und`, with score 0, if text is null or has no letter or nothing
    could be learnt; of equal cosines the first language by name wins. Every letter has a vector of its own. A row for
    each row: repeated ones have equal results, very long texts are read whole, an empty table gives an empty result,
    and other columns are ignored, whatever their names. More than LANGUAGES values of lang are an error.
    """
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    learnt = prototypes(rows.filter("not held_out").select("lang", F.coalesce("text", F.lit("")).alias("text")))
    out = predict(keyed(docs), learnt)
    key = F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.col("doc_id").cast("string"))
    return out.select(doc_id(), "lang_pred", "score").select("doc_id", (F.crc32(key.cast("binary")) % 3 == 1).alias("held_out"), "lang_pred", "score")
