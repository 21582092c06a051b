"""The queries over whole tables against their SQL, and the pipeline against brute force."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
from oracle import differences
from test_documents import brute_classes
from test_repeats import brute_words

from docframe.llm import queries
from docframe.llm._text import Chunk
from docframe.llm.pieces import Pieces
from docframe.llm.sentencepiece_codec import Codec
from docframe.llm.toxicity import bags, held_out, learn

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert differences(spark, queries, name, DATA) == []


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_a_row_for_each_document(spark, name):
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(queries.queries()[name](spark, DATA)) == ids(spark.read.parquet(f"{DATA}/documents.parquet"))


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda x: x[0].lower(), text))


def toxic(model, text):
    """Noisy-or, sentence by sentence."""
    c, clean = Chunk([text.encode()]), 1 - model.leak
    word, sentence, _ = bags(c)
    for s in set(sentence.tolist()):
        weights = [float(model.weights[w]) for w in word[sentence == s] if model.weights[w] != 0]
        if weights:
            clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(weights))))
    return 1 - clean >= 0.3


def test_pipeline(spark, tmp_path):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = learn(docs.filter(~held_out("doc_id")), spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {i: r for i, r in rows.items() if not toxic(model, r["text"])}
    kept = [want]
    first = {i for i, _, c in brute_classes([(i, r["text"]) for i, r in want.items()]) if i == c}
    kept.append({i: r for i, r in want.items() if i in first})
    cut = {}
    pairs = [(i, r["text"]) for i, r in kept[1].items()]
    for i, n, gone, sha in brute_words(pairs, 50):
        cut[i] = (gone, sha)
    windows = set()
    for r in bench.collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    dirty = lambda t: any(tuple(w[k : k + m]) in windows for w in [words(t)] for m in sizes for k in range(len(w) - m + 1))

    got, codec = docs, Codec(Pieces.load(queries.PIECES))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, got, DATA).write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        now = {r["doc_id"]: r.asDict() for r in got.collect()}
        assert got.count() == len(now)
        if k < 4:
            assert got.columns == docs.columns
        if k < 2:
            assert now == kept[k]
        elif k == 2:
            assert now.keys() == kept[1].keys()
            for i, r in now.items():
                gone, sha = cut[i]
                if gone:
                    assert hashlib.sha256(r["text"].encode()).hexdigest() == sha and r["n_chars"] == len(r["text"])
                else:
                    assert r == kept[1][i]
            last = now
        elif k == 3:
            assert now == {i: r for i, r in last.items() if not dirty(r["text"])}
            last = now
        else:
            assert {i: r["ids"] for i, r in now.items()} == {i: codec.encode([r["text"].encode()])[0].tolist() for i, r in last.items()}
            assert all(r["restored"] for r in now.values())
    assert len(rows) >= len(kept[0]) > len(kept[1]) and any(g for g, _ in cut.values())


def test_stages_on_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, "null id", None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "twice the same", "en", "a", 14), (3, "twice the same", "en", "a", 14)]
    for table, n in (([], 0), (odd, 4)):
        docs = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, DATA)
            if k < 4:
                docs = spark.createDataFrame(docs.collect(), schema)
        assert docs.count() == n


def test_one_document_of_each_class(spark):
    """Classes stay apart where their least id is null or a repeated one."""
    words = lambda k, n=30: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None, words(k)) for k in range(6)] + [(7, words(10)), (7, words(11)), (8, words(11) + " more"), (None, words(12)), (9, words(12) + " more"), (10, words(13)), (10, words(13)), (11, ""), (11, "")]
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), DATA)
    want = [(None, words(k)) for k in (0, 1, 2, 3, 4, 5, 12)] + [(7, words(10)), (7, words(11)), (10, words(13)), (11, ""), (11, "")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
