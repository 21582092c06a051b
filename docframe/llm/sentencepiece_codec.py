"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's state is the longest suffix that begins a piece; following the output links
from there gives every piece that ends at the position, longest first, and each relaxes the position's best
score. A pre-token (which no piece reaches over) is a position range of its own, so equal ones share a result.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._runtime import doc_id, keyed, ship
from ._text import chunks, lists, raw, slices
from .pieces import Pieces, escaped
from .word_table import WordTable

#: Pre-tokens whose ids a worker keeps.
WORDS = 3 << 18


class Automaton:
    """States by breadth: goto, failure link, the piece that ends there (length, score, id), next state with one."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.goto: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, float, int] | None] = [None]
        for p, i in pieces.ids.items():
            state = 0
            for char in p:
                state = self.goto[state].setdefault(char, len(self.goto))
                if state == len(self.goto):
                    self.goto.append({})
                    self.piece.append(None)
            self.piece[state] = (len(p), pieces.scores[p], i)
        self.fail, self.link = [0] * len(self.goto), [0] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for char, child in self.goto[state].items():
                back = self.fail[state]
                while back and char not in self.goto[back]:
                    back = self.fail[back]
                self.fail[child] = back = self.goto[back].get(char, 0)
                self.link[child] = back if self.piece[back] else self.link[back]
                queue.append(child)
        for child in self.goto[0].values():
            self.link[child] = 0
        none: dict[str, int] = {}
        self.goto = [g or none for g in self.goto]

    def encode(self, word: str) -> list[int]:
        """Ids of the segmentation with the greatest sum of scores."""
        goto, piece, fail, link = self.goto, self.piece, self.fail, self.link
        unknown, ids = self.pieces.unknown_score_, self.pieces.ids
        best, taken, state = [0.0], [(0, 0)], 0
        for j, char in enumerate(word, 1):
            while state and char not in goto[state]:
                state = fail[state]
            state = goto[state].get(char, 0)
            score, choice = float("-inf"), (1, -1)
            out = state if piece[state] else link[state]
            while out:
                size, s, i = piece[out]
                if best[j - size] + s > score:
                    score, choice = best[j - size] + s, (size, i)
                out = link[out]
            if char not in ids and best[j - 1] + unknown > score:
                score, choice = best[j - 1] + unknown, (1, -1)
            best.append(score)
            taken.append(choice)
        out_ids: list[int] = []
        j = len(word)
        while j:
            size, i = taken[j]
            out_ids.extend([i] if i >= 0 else reversed(self.pieces.fallback(word[j - 1])))
            j -= size
        return out_ids[::-1]


class Codec:
    """Encodes texts to arrays of 32-bit ids and back; keeps the ids of pre-tokens by hash."""

    def __init__(self, pieces: Pieces):
        pieces.unknown_score_ = pieces.unknown_score
        self.pieces, self.automaton = pieces, Automaton(pieces)
        self.table = WordTable("<u4", WORDS)

    def _make(self, words: list[bytes]) -> list[bytes]:
        return [array("I", self.automaton.encode(escaped(w))).tobytes() for w in words]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        c = self.pieces.pretokens(texts)
        ids, begin = self.table.look_up(c, self._make)
        return [ids[a:z] for a, z in zip(begin[c.lo].tolist(), begin[c.hi].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.pieces.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_codecs: dict[int, Codec] = {}


def codec(held) -> Codec:
    """The worker's codec for a broadcast model."""
    pieces = held.value
    key = hash(tuple(pieces.scores.items()))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(pieces)
    return _codecs[key]


def sentencepiece_encode(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """Encode each whole text with the pieces and scores of a SentencePiece model file, decode it again.

    Takes doc_id and text, returns doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded text's UTF-8), restored (it equals the text) and, with keep_ids,
    ids. A space is put before a text and spaces are written U+2581, as the model's format asks for, so a text
    that has U+2581 itself is decoded with spaces there. Characters without a piece become byte pieces, or the
    unknown piece if the model has none. Null counts as empty; an empty text has no ids.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(Pieces.load(model))

    def run(batches):
        c = codec(held)
        for b in slices(batches, 1024):
            for i, j, chunk in chunks(raw(b.column("text"))):
                texts, rows, kept = chunk.texts, [], []
                for t, ids in zip(texts, c.encode(texts)):
                    back = c.decode(ids).encode("utf-8")
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back).hexdigest(), back == t))
                    kept.append(ids)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                all_ids = lists(np.concatenate(kept).astype(np.int32), np.fromiter(map(len, kept), np.int64), pa.int32()) if keep_ids else pa.nulls(len(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, len(texts)), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds)), all_ids],
                    ["id", "n_tokens", "ids_crc32", "decoded_sha256", "restored", "ids"],
                )

    schema = "id long, n_tokens long, ids_crc32 long, decoded_sha256 string, restored boolean, ids array<int>"
    out = keyed(docs).select("id", "text").mapInArrow(run, schema)
    return out.select(doc_id(), "n_tokens", "ids_crc32", "decoded_sha256", "restored", *(["ids"] if keep_ids else []))
