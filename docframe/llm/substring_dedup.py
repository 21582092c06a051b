"""Substring dedup by relative Lempel-Ziv parsing over words.

Contexts that share an anchor (see repeats.py) are a reference block, indexed by the hash of each window of
50 words. Every context is factored greedily against what documents with smaller ids have put into the block: at
the first place whose window is in the index, the longest match with the indexed place becomes a factor and a
duplicate span; words are compared, not hashes. A match that straddles a factor's end starts behind the last
window inside the factor, so parsing goes on there, not at the factor's end: no window is lost at a boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import doc_id
from ._text import grams, new_seed
from .repeats import OWN, REST, Repeats, Shard, Windows, find, removed

GRAM = 10


def _common(units: np.ndarray, p: np.ndarray, r: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal units from p and r on, `most` at most."""
    size, go = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(go):
        go = go[size[go] < most[go]]
        go = go[units[p[go] + size[go]] == units[r[go] + size[go]]]
        size[go] += 1
    return size


def factored(s: Shard, w: Windows) -> Repeats:
    """The factors that refer to a document with a smaller id. All contexts are parsed side by side.

    A context is parsed once as its representative's and, if it occurs under greater ids too, once as theirs: then
    the representative itself is in the block.
    """
    n = len(s.start)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    key = grams(s.chunk.hash, w.size, w.seed)[s.start]
    order = np.lexsort((np.arange(n), key))  # contexts ascend by id, so do a key's places
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    index = np.empty(n, np.int64)
    index[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    earlier = s.id[s.of[index]] < s.id[s.of]
    # the next window that has a place in the block
    following = np.append(np.where(earlier, np.arange(n), n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    end = s.base + s.count
    context = np.concatenate((np.flatnonzero(~s.guest), np.flatnonzero(s.more)))
    kind = np.repeat([OWN, REST], (int((~s.guest).sum()), int(s.more.sum())))
    at, out = s.base[context], []
    while len(context):
        at = np.where(kind == OWN, following[at], at)
        live = at < end[context]
        context, kind, at = context[live], kind[live], at[live]
        other = index[at]
        most = w.size - 1 + np.minimum(end[context] - at, end[s.of[other]] - other)
        size = _common(s.units, s.start[at], s.start[other], most)
        good = size >= w.size
        a = at - s.base[context]
        out.append(np.stack((context, a, a + size, kind))[:, good])
        at = at + np.where(good, size - w.size, 0) + 1
    context, a, z, kind = np.concatenate(out, axis=1)
    return context, a, z, kind


def substring_dedup(docs: DataFrame, words: int = 50, keep_text: bool = False) -> DataFrame:
    """Removes each word under a window of `words` words that also starts in a document with a smaller doc_id.

    Takes doc_id and text (null: none); words are runs of anything but ASCII white space. Returns doc_id,
    n_words, n_removed, n_spans, kept_sha256 (kept words joined by a space) and, with keep_text, kept: those
    words, null where nothing was removed. Rows with one doc_id never remove each other's words, equal ones have
    equal results; a null doc_id counts as smaller than all others; empty and short texts lose nothing, very long ones
    are taken whole; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    w = Windows(True, words, min(GRAM, words), new_seed())
    out = removed(find(docs, w, factored, earlier=True), w, keep_text)
    more = ["th", "kept"] if keep_text else []
    return out.select(doc_id(), F.col("n").alias("n_words"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), *more)
