"""Pieces and scores of a SentencePiece model file, and the pre-tokens that no piece crosses."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ._text import Chunk

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6


@dataclass
class Pieces:
    """ids and scores by piece; byte_ids[b] is the id of byte b, empty if the model has no byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: int
    surface: list[bytes]
    cut: bool = field(default=True)

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        ids, scores, by_byte, unknown, surface = {}, {}, {}, 0, []
        for i, p in enumerate(proto.pieces):
            surface.append(b"")
            if p.type == NORMAL:
                ids[p.piece], scores[p.piece] = i, p.score
                surface[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == BYTE:
                by_byte[int(p.piece[3:5], 16)] = i
                surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == UNKNOWN:
                unknown, surface[i] = i, " ⁇ ".encode()
        cut = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids)
        return cls(ids, scores, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], unknown, surface, cut)

    @property
    def unknown_score(self) -> float:
        """Of a character without a piece: below any piece's."""
        return min(self.scores.values(), default=0.0) - 10

    def fallback(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def pretokens(self, texts: list[bytes]) -> Chunk:
        """The texts, a space put before each, as a chunk whose words are cuts that no piece reaches over.

        A cut begins at spaces behind something else, and at and behind a line's end.
        """
        c = Chunk([b" " + t if t else t for t in texts])
        if not self.cut:
            some = c.size > 0
            c.cut(c.at[some], (c.at + c.size)[some])
        else:
            space, line = c.data == 0x20, c.data == 0x0A
            new = np.zeros(len(c.data) + 1, bool)
            new[1:-1] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
            between = c.at + c.size
            new[c.at] = new[between] = True
            new[-1] = True
            start = np.flatnonzero(new)
            real = np.ones(len(new), bool)
            real[between] = False
            keep = real[start[:-1]]
            c.cut(start[:-1][keep], start[1:][keep])
        return c


def escaped(word: bytes) -> str:
    """Spaces as the model's pieces have them."""
    return word.decode("utf-8", "replace").replace(" ", SPACE)
