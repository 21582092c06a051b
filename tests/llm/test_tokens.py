"""Counting, encoding and storing tokens against the public libraries and brute force."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from docframe.llm._text import SPACED, Chunk
from docframe.llm.huffman import Code, code_lengths
from docframe.llm.pieces import Pieces, escaped
from docframe.llm.sentencepiece_codec import Codec, sentencepiece_encode
from docframe.llm.token_counts import CountTrie, token_counts
from docframe.llm import token_counts as counting
from docframe.llm.token_output import read_tokens, token_output, write_tokens
from docframe.llm.word_table import WordTable

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a  b   c", " lead and trail ", "É é ç ß́ x y z", "<|endoftext|> x<|startoftext|>y", "日本語 テスト 😀", "▁ odd", "don't we'll I'm 123 4.5!?", "x" * 3000, "tab\tcr\r\nvt\x0bff\x0cfs\x1cus\x1f."]


def texts(seed, n=150):
    r = random.Random(seed)
    some = [t for t in ODD if t]
    out = list(ODD)
    while len(out) < n:
        out.append(" ".join(r.choice(["the", "ation", "Worthless", "Über", "naïve", "x1y2", r.choice(some), "".join(r.choice("abcdeénß") for _ in range(r.randint(1, 12)))]) for _ in range(r.randint(1, 60))))
    return out


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(PIECES)


def test_code_lengths_are_optimal():
    r = np.random.default_rng(1)
    for n, limit in ((1, 4), (2, 4), (5, 3), (200, 18), (200, 8), (1000, 11)):
        counts = (r.pareto(1.0, n) * 10 + 1).astype(np.int64)
        lengths = code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
        if limit == 18:  # no limit in effect: as good as Huffman's own tree
            heap, total = [(int(c), i) for i, c in enumerate(counts)], 0
            heapq.heapify(heap)
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                total += a[0] + b[0]
                heapq.heappush(heap, (a[0] + b[0], 0))
            assert int((counts * lengths).sum()) == total
    assert code_lengths(np.zeros(4, np.int64), 8).sum() == 0


def test_code_round_trip():
    r = np.random.default_rng(2)
    counts = np.bincount((r.pareto(0.7, 50_000) * 3).astype(np.int64) % 3000, minlength=3000)
    code = Code(code_lengths(counts, 14), 14)
    used = np.flatnonzero(counts)
    streams = [r.choice(used, n) for n in (1, 511, 512, 513, 5000, 0, 1024)]
    blocks, offsets = zip(*(code.encode(s) for s in streams))
    assert np.array_equal(code.decode(list(blocks), list(offsets), [len(s) for s in streams]), np.concatenate(streams))
    assert np.array_equal(code.decode([blocks[4]], [offsets[4]], [5000]), streams[4])


def expected(rows):
    t = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_output(spark):
    rows = [(3 * i - 50, t) for i, t in enumerate(texts(3))]
    random.Random(1).shuffle(rows)
    got = token_output(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected(sorted(rows, key=lambda r: r[0]))


def test_token_output_edges(spark):
    schema = "doc_id long, text string, uid int"
    assert token_output(spark.createDataFrame([], schema), WORDS).count() == 0
    rows = [(None, "null id", 1), (5, "twice", 1), (5, "twice", 1), (5, "other", 1), (6, None, 1)]
    got = token_output(spark.createDataFrame(rows, schema), WORDS).collect()
    by = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by] == [None, 5, 5, 5, 6]
    assert [r["start"] for r in by] == np.cumsum([0, *(r["n_tokens"] for r in by[:-1])]).tolist()
    assert by[-1]["n_tokens"] == 1


def test_blocks_hold_every_id(spark, tmp_path):
    rows = list(enumerate(texts(4, 60)))
    files = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2, str(tmp_path / "files"))
    t = Tokenizer.from_file(WORDS)
    from pyspark.sql.types import ArrayType  # noqa: F401
    import pyarrow as pa

    got = read_tokens(spark, files, lambda ids: [ids.tolist()], "all array<long>", [pa.list_(pa.int64())])
    assert {r["id"]: r["all"] for r in got.collect()} == {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows}


def viterbi(pieces, text):
    """Ids by plain dynamic programming over the whole text."""
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    best, back = [0.0], [None]
    for j in range(1, len(text) + 1):
        options = [(best[i] + pieces.scores[text[i:j]], -i, [pieces.ids[text[i:j]]]) for i in range(max(0, j - 20), j) if text[i:j] in pieces.scores]
        if text[j - 1] not in pieces.scores:
            options.append((best[j - 1] + pieces.unknown_score, -(j - 1), pieces.fallback(text[j - 1])))
        score, i, ids = max(options, key=lambda o: (o[0], o[1]))
        best.append(score)
        back.append((-i, ids))
    out, j = [], len(text)
    while j:
        j, ids = back[j]
        out[:0] = ids
    return out


def test_sentencepiece_is_the_best_segmentation(pieces):
    codec = Codec(pieces)
    trie = CountTrie(pieces)
    for t in texts(5, 80):
        ids = codec.encode([(t or "").encode()])[0].tolist()
        assert ids == viterbi(pieces, t or "")
        c = pieces.pretokens([(t or "").encode()])
        words = [escaped(c.word(i)) for i in range(len(c.start))]
        assert "".join(words) == ("▁" + t.replace(" ", "▁") if t else "")
        assert sum(trie.insert(sorted(words))) == len(ids)


def test_sentencepiece_as_the_library_has_it(pieces):
    """The library's own unigram encoder over the same pieces, on texts whose characters are pieces."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec, r = Codec(pieces), random.Random(6)
    for _ in range(300):
        t = " ".join("".join(r.choice("abcdefghinorst") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6)))
        ids = codec.encode([t.encode()])[0]
        assert ids.tolist() == library.encode(t)
        assert codec.decode(ids) == library.decode(ids.tolist()) == t


def test_word_table():
    """Tiny tables, which are cleared and have crowded slots."""
    table = WordTable("<u2", 4)
    make = lambda words: [np.frombuffer(w[:3] + b"\0" * (-len(w[:3]) % 2), "<u2").tobytes() for w in words]
    r = random.Random(1)
    for _ in range(200):
        texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 9))).encode() for _ in range(3)]
        c = Chunk(texts)
        c.words(SPACED)
        ids, begin = table.look_up(c, make)
        got = [ids[a:z].tobytes() for a, z in zip(begin[:-1], begin[1:])]
        assert got == make([w for t in texts for w in t.split()])


def test_encode_and_count_tables(spark, pieces, monkeypatch):
    monkeypatch.setattr(counting, "NODES", 50)
    rows = [(i, t, 0) for i, t in enumerate(texts(7))] + [(None, "null id", 0), (3, "\n\n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sentencepiece_encode(docs, PIECES).collect()
    want = []
    for i, t, _ in rows:
        ids = viterbi(pieces, t or "")
        back = (t or "").replace("▁", " ")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or ""), ids))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    counts = token_counts(docs, PIECES).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in counts), key=str) == sorted(((w[0], w[1]) for w in want), key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(none, PIECES).count() == sentencepiece_encode(none, PIECES).count() == 0
