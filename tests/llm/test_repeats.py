"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from docframe.llm import repeats
from docframe.llm.substring_dedup import substring_dedup
from docframe.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, n_bytes string, th int"


def corpus(seed, n=60):
    """Documents that share passages, repeat themselves, are copies, null or empty."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 5))) for _ in range(40)]
    some = lambda k: [r.choice(words) for _ in range(k)]
    passages = [some(r.randint(10, 40)) for _ in range(4)]
    texts = [None, "", "   ", "a", "aaaaaaaa" * 20, "x " * 80]
    while len(texts) < n:
        t = some(r.randint(0, 50))
        for _ in range(r.randint(0, 2)):
            i = r.randint(0, len(t))
            t[i:i] = r.choice(passages)[r.randint(0, 5) :]
        texts.append(r.choice([" ", " ", "\n"]).join(t))
        if r.random() < 0.2:
            texts.append(r.choice(texts))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


def brute_bytes(rows, length):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, size):
    raw = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    least = {}
    low = lambda i: -(2**63) if i is None else i
    for i, w in raw:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            least[k] = min(low(i), least.get(k, low(i)))
    out = []
    for i, w in raw:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if least[tuple(w[p : p + size])] < low(i):
                gone[p : p + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.fixture(params=["cold", "hot"])
def limits(request, monkeypatch):
    """hot: anchors with few contexts are already split over shards."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    if request.param == "hot":
        monkeypatch.setattr(repeats, "HOT", 2)


@pytest.mark.parametrize("seed,length", [(1, 40), (2, 24), (3, 200)])
def test_suffix_dedup(spark, limits, seed, length):
    rows = corpus(seed)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), length)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, length)


@pytest.mark.parametrize("seed,size", [(4, 12), (5, 6), (6, 20)])
def test_substring_dedup(spark, limits, seed, size):
    rows = corpus(seed)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), size)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows, size)


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(70))
    rows = [(None, long, "", 0), (3, long, "", 0), (3, long, "", 0), (3, long + " tail", "", 0), (None, None, "", 0)]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows, 50)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 200)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup(none).count() == 0
    assert substring_dedup(none, keep_text=True).count() == 0
