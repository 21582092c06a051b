"""Token counts under a unigram model by dynamic programming over a trie of distinct pre-tokens.

A node stands for a prefix that pre-tokens share; its forward score and the count of tokens on its best path
are computed once, from its ancestors, when the node is made. A pre-token's count is that of its last node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import doc_id, keyed, ship
from ._text import chunks, raw
from .pieces import Pieces, escaped
from .word_table import WordTable

#: Nodes of a trie before a worker begins a new one.
NODES = 300_000


class CountTrie:
    def __init__(self, pieces: Pieces):
        self.pieces, self.scores, self.unknown = pieces, pieces.scores, pieces.unknown_score
        self.longest = max(map(len, self.scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best, self.count = [0.0], [0]

    def insert(self, words: list[str]) -> list[int]:
        """The counts of sorted words. What a word shares with the one before it isn't walked again."""
        children, best, count, scores, longest = self.children, self.best, self.count, self.scores, self.longest
        path, last, out = [0], "", []
        for word in words:
            d, most = 0, min(len(word), len(last))
            while d < most and word[d] == last[d]:
                d += 1
            del path[d + 1 :]
            node = path[d]
            while d < len(word):
                char = word[d]
                d += 1
                child = children[node].get(char)
                if child is None:
                    score, tokens = float("-inf"), 0
                    for at in range(max(0, d - longest), d):  # of equal scores the longest piece's counts
                        if (s := scores.get(word[at:d])) is not None and best[path[at]] + s > score:
                            score, tokens = best[path[at]] + s, count[path[at]] + 1
                    if char not in scores and best[node] + self.unknown > score:
                        score, tokens = best[node] + self.unknown, count[node] + len(self.pieces.fallback(char))
                    child = children[node][char] = len(best)
                    children.append({})
                    best.append(score)
                    count.append(tokens)
                node = child
                path.append(node)
            last = word
            out.append(count[node])
        return out


class Counter:
    """Counts of pre-tokens, kept by hash."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.trie, self.table = pieces, CountTrie(pieces), WordTable("<u4")

    def _make(self, words: list[bytes]) -> list[bytes]:
        if len(self.trie.best) > NODES:
            self.trie.clear()
        names = list(map(escaped, words))
        order = sorted(range(len(names)), key=names.__getitem__)
        out = [b""] * len(words)
        for i, n in zip(order, self.trie.insert([names[i] for i in order])):
            out[i] = n.to_bytes(4, "little")
        return out

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each text."""
        c = self.pieces.pretokens(texts)
        n, _ = self.table.look_up(c, self._make)
        total = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        return c.hi - c.lo, total[c.hi] - total[c.lo]


_counters: dict[int, Counter] = {}


def _count(held):
    def run(batches):
        pieces = held.value
        key = hash(tuple(pieces.scores.items()))
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(pieces)
        for b in batches:
            for i, j, c in chunks(raw(b.column("text"))):
                pretokens, n = _counters[key].count(c.texts)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(n), pa.array(pretokens)], ["id", "n_tokens", "n_pretokens"])

    return run


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """Tokens of each whole text under the pieces and scores of a SentencePiece model file, as a unigram model.

    Takes doc_id and text, returns doc_id, n_pretokens and n_tokens, a row for each row. The best segmentation
    has the greatest sum of scores; of equals the longer last piece counts. A character without a piece counts
    as its UTF-8 bytes if the model has byte pieces, else as one. Null and empty texts have 0 tokens.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(Pieces.load(model))
    out = keyed(docs).select("id", "text").mapInArrow(_count(held), "id long, n_tokens long, n_pretokens long")
    return out.select(doc_id(), "n_pretokens", F.col("n_tokens"))
