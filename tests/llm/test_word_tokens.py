"""Ids of words that a worker doesn't know yet, found together, against the library's whole pipeline."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docframe.llm._text import Chunk
from docframe.llm.token_output import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, encoding="utf-8") as f:
        return WordTokenizer(f.read(), "<u2")


def ids(tokenizer, texts):
    return [np.frombuffer(x, "<u2").tolist() for x in tokenizer.batch(Chunk([t.encode() for t in texts]))]


def test_words_of_all_kinds(tokenizer):
    r, library = random.Random(7), Tokenizer.from_file(PATH)
    signs = ["a", "Z", "é", "É", "İ", "ß", "ª", "Ǆ", "'s", "'LL", "'", "!", "9", "½", " ", "­", "+"]
    signs += ["<|", "|>", "Σ", "ς", "ж", "語", "é", "Å", "\u0000", "\u007f", "�"]
    for some in (signs[:4], signs[:17], signs):  # all plain, or some for the library
        texts = [" ".join("".join(r.choice(some) for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 30))) for _ in range(60)]
        texts += ["", " ", "<|endoftext|> x", "ΣΑΣ ΟΔΟΣ"]
        assert ids(tokenizer, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_library_takes_other_words_together(tokenizer, monkeypatch):
    calls, whole = [], tokenizer._whole
    monkeypatch.setattr(tokenizer, "_whole", lambda texts: calls.append(len(texts)) or whole(texts))
    text = " ".join([f"слово{i} word{i}" for i in range(50)])
    assert ids(tokenizer, [text]) == [Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids]
    assert calls == [50]
