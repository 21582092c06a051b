"""Words and texts that weak hashes take for each other, very long texts, and folders that aren't shared."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import brute_classes, brute_contamination, rows_of
from test_repeats import brute_bytes, brute_words
from tokenizers import Tokenizer

from docframe.errors import StorageError
from docframe.llm import _runtime, _text, jaccard_join, repeats
from docframe.llm._text import SPACED, Chunk
from docframe.llm.decontaminate import decontaminate
from docframe.llm.fingerprint import fingerprints
from docframe.llm.jaccard_join import jaccard_classes
from docframe.llm.language_id import language_id
from docframe.llm.sentencepiece_codec import sentencepiece_encode
from docframe.llm.substring_dedup import substring_dedup
from docframe.llm.suffix_dedup import suffix_dedup
from docframe.llm.token_counts import token_counts
from docframe.llm.token_output import token_output
from docframe.llm.word_table import WordTable

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def twins(a, b, steps=11):
    """A Thue-Morse sequence over a and b, and the same with both exchanged."""
    x, y = [a], [b]
    for _ in range(steps):
        x, y = x + y, y + x
    return x, y


@pytest.fixture(scope="module")
def rows():
    one, two = ("".join(t) for t in twins("a", "b"))
    common = [f"w{i}" for i in range(49)]
    texts = [one, two, " ".join([*common, one]), " ".join([*common, two]), " ".join(["tail", *common[:9], one])]
    texts += [" ".join(t) for t in twins("left", "right", 8)]
    return list(enumerate(texts))


def test_twins_are_different_words(rows):
    c = Chunk([rows[0][1].encode(), rows[1][1].encode()])
    c.words(SPACED)
    assert c.hash[0] != c.hash[1] and len(set(c.exact().tolist())) == 2


def test_twins_in_token_operators(spark, rows):
    docs, t = spark.createDataFrame(rows, SCHEMA).coalesce(1), Tokenizer.from_file(WORDS)
    ids = {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in rows}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_output(docs, WORDS).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    pieces = {r["doc_id"]: r for r in sentencepiece_encode(docs, PIECES).collect()}
    assert all(r["restored"] and r["decoded_sha256"] == hashlib.sha256(dict(rows)[i].encode()).hexdigest() for i, r in pieces.items())
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, PIECES).collect()} == {i: r["n_tokens"] for i, r in pieces.items()}


def test_twins_in_document_operators(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    assert rows_of(jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == brute_classes(rows)
    assert rows_of(substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows, 50)
    assert rows_of(suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 200)
    items = [(1, rows[0][1]), (2, " ".join(["x", *(f"w{i}" for i in range(8)), rows[0][1]])), (3, " ".join([*(f"w{i}" for i in range(40, 49)), rows[0][1]]))]
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_contamination(rows, items)


@pytest.fixture
def weak(monkeypatch):
    """Hashes of words with three bits."""
    strong = _text.spans
    monkeypatch.setattr(_text, "spans", lambda *a: strong(*a) & np.uint64(7))


def test_words_by_bytes(weak):
    table, r = WordTable("<u2", 50), random.Random(4)
    make = lambda words: [np.frombuffer(w[:9] + b"\0" * (-len(w[:9]) % 2), "<u2").tobytes() for w in words]
    for _ in range(60):
        texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 20))) for _ in range(r.randint(0, 9))).encode() for _ in range(3)]
        c = Chunk(texts)
        c.words(SPACED)
        ids, begin = table.look_up(c, make)
        assert [ids[a:z].tobytes() for a, z in zip(begin[:-1], begin[1:])] == make([w for t in texts for w in t.split()])
        words, number = [c.word(i) for i in range(len(c.start))], c.exact().tolist()
        assert len(set(zip(words, number))) == len(set(words)) == len(set(number))


def test_signatures_that_clash(spark, monkeypatch):
    """Sets of one signature that differ in the other hash are classes of their own, and links are checked by words."""
    first = jaccard_join.Sets.__init__

    def weak(self, chunk, sim):
        first(self, chunk, sim)
        self.signature = self.signature & 3

    monkeypatch.setattr(jaccard_join.Sets, "__init__", weak)
    r, rows = random.Random(2), []
    for i in range(12):
        words = [f"w{r.randrange(500)}" for _ in range(r.choice([3, 30, 60]))]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words)), (3 * i + 2, " ".join([*words, "more"]))]
    # in this process, as a patch doesn't reach the workers
    texts = [t.encode() for _, t in rows]
    s = jaccard_join.Sets(Chunk(texts), jaccard_join.Similarity())
    clash = np.array([x for x in set(s.signature.tolist()) if len(set(s.check[s.signature == x].tolist())) > 1])
    classes = s.classes(clash).tolist()
    assert len(clash) and len({(c, t) for c, t in zip(classes, [t for _, t in rows])}) == len(set(classes)) == len(set(texts))


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup])
def test_only_the_matcher_removes(spark, monkeypatch, operator):
    """With a matcher that finds nothing nothing goes, not even copies."""
    text = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame([(i, text) for i in range(4)], SCHEMA)
    assert {r["n_removed"] > 0 for r in operator(docs).collect()} == ({True} if operator is suffix_dedup else {True, False})
    find, none = repeats.find, lambda s, w: (np.zeros(0, np.int64),) * 4
    monkeypatch.setattr(f"{operator.__module__}.find", lambda docs, w, match, earlier: find(docs, w, none, earlier))
    assert {r["n_removed"] for r in operator(docs).collect()} == {0}


def test_shared_folder(spark, monkeypatch, tmp_path):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(StorageError):
        _runtime.scratch(Session())
    with pytest.raises(StorageError), monkeypatch.context() as m:  # a folder of which the reader sees a part
        m.setattr(_runtime, "_checked", set())
        m.setattr(type(spark.read), "parquet", lambda self, path: spark.range(3).toDF("id"))
        _runtime.materialise(spark.range(10))
    kept = _runtime.materialise(spark.range(10).repartition(3), most=F.max("id"))
    assert kept.count() == 10 and kept.seen == {"n": 10, "most": 9}
    _runtime.discard(kept)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept._docframe_path)


def test_tables_are_cleared_away(spark, monkeypatch, tmp_path):
    """Of what operators write on the way only what their results read is left."""
    base = tmp_path / "shared"
    monkeypatch.setattr(_runtime, "scratch", lambda spark: f"{base}/{len(list(base.glob('*'))) if base.exists() else 0}-{random.random()}")
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(70))) for i in range(20)]
    jaccard_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    left = {p.name for p in base.glob("*")}
    suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({p.name for p in base.glob("*")} - left) <= 3


def long_rows():
    """A text of 4 MB in one line, parts of which others repeat, one of 1 MB without a space, and short ones."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    text = " ".join(r.choice(words) for _ in range(600_000))
    return [(1, text), (2, "start " + text[1_000_000:1_500_000]), (3, "x" * 1_000_000), (4, "short"), (5, None)]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame(long_rows(), SCHEMA).repartition(3)


def test_very_long_texts(spark, long_docs):
    rows = long_rows()
    text = {i: t or "" for i, t in rows}
    got = {r["doc_id"]: r for r in suffix_dedup(long_docs).collect()}
    assert got[2]["n_removed"] == 500_000 + (1 if text[1][999_999] == " " else 0) and got[3]["n_removed"] == 1_000_000 and got[4]["n_removed"] == 0
    got = {r["doc_id"]: r for r in substring_dedup(long_docs).collect()}
    assert got[1]["n_removed"] == got[3]["n_removed"] == 0 and len(text[2].split()) - got[2]["n_removed"] <= 3
    got = {r["doc_id"]: r for r in jaccard_classes(long_docs).collect()}
    w = text[1].split()
    assert got[1]["n_shingles"] == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) and [got[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 3]
    items = spark.createDataFrame([(9, " ".join(w[400_000:400_030]))], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate(long_docs, items).collect()}
    assert got[1] >= 30 and got[3] == got[4] == 0
    got = {r["doc_id"]: r for r in fingerprints(long_docs).collect()}
    assert got[1]["n_chars"] == len(text[1]) and len(got[1]["fingerprint"]) == 1024 and 0 <= got[3]["near_edited"] <= 1
    assert {r["doc_id"]: r["lang_pred"] for r in language_id(long_docs.selectExpr("doc_id", "text", "'xx' as lang")).collect()} == {1: "xx", 2: "xx", 3: "xx", 4: "xx", 5: "und"}
