"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the sum of its words' weights, 0
if no word has one; the document's is the noisy-or of its sentences' and of a leak, the chance that a document
is labelled for nothing that can be told: 1 - (1 - leak) * product(1 - score). Only documents are labelled, so
all is fitted to the likelihood of the documents' labels; the sentence scores then locate what offends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import added, doc_id, keyed, ship
from ._text import ALNUM, Chunk, U, chunks, raw

#: Labelled documents learnt from at most, word buckets (bits), documents that a word must be in, its least
#: likelihood ratio statistic, steps of a fit, shrinkage of weights, the weight below which a word is dropped, and
#: the logit of a sentence whose words weigh nothing.
SAMPLE, BITS, SEEN, EVIDENCE, STEPS, SHRINK, WEAK, BIAS = 8_000, 20, 4, 15, 200, 1e-4, 2.0, -5.0
#: A document is rejected from here on.
THRESHOLD = 0.3

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def bags(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, its sentence, each sentence's document); a sentence has at least one word."""
    c.words(ALNUM, fold=True)
    ends = np.concatenate(([0], np.cumsum(_ENDS[c.data])))
    doc = np.searchsorted(c.at, c.start, "right") - 1
    place = ends[c.start]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))[: len(place)]
    return (c.hash >> U(64 - BITS)).astype(np.int64), np.cumsum(new) - 1, doc[new]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float  # the logit of a sentence whose words weigh nothing
    leak: float

    def sentences(self, word: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Score of each sentence."""
        weight = self.weights[word]
        known = np.bincount(sentence, weight != 0, minlength=n) > 0
        return np.where(known, sigmoid(self.bias + np.bincount(sentence, weight, minlength=n)), 0.0)

    def documents(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Score of each of n documents, from its sentences'."""
        return 1 - (1 - self.leak) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Weights for the labels of documents, by Adam steps on the noisy-or likelihood with a small L1 shrinkage."""
    words, sentences, docs, at = [], [], [], 0
    for i, _, c in chunks(texts):
        w, s, d = bags(c)
        words.append(w.astype(np.int32))
        sentences.append((s + at).astype(np.int32))
        docs.append(d + i)
        at += len(d)
    none = Model(np.zeros(1 << BITS, np.float32), BIAS, 0.0)
    if not len(labels) or not labels.any():
        return none
    word, sentence, doc = np.concatenate(words), np.concatenate(sentences), np.concatenate(docs)
    # words that differ between the labels by more than chance
    seen = np.unique(doc[sentence].astype(np.int64) << BITS | word) if len(word) else np.zeros(0, np.int64)
    of, w = seen >> BITS, seen & ((1 << BITS) - 1)
    total, toxic = np.bincount(w, minlength=1 << BITS), np.bincount(w, labels[of], minlength=1 << BITS)
    rate = labels.mean()
    share = lambda k, expected: k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9))
    g = 2 * (share(toxic, rate * total) + share(total - toxic, (1 - rate) * total))
    chosen = np.flatnonzero((total >= SEEN) & (toxic > rate * total) & (g > EVIDENCE))
    theta = _climb(word, sentence, doc, labels, chosen, np.minimum(np.sqrt(g[chosen]) / 4, 4))
    strong = theta[:-1] > WEAK  # the shrinkage leaves the rest near 0; the fit is then repeated without them
    chosen, start = chosen[strong], theta[:-1][strong]
    theta = _climb(word, sentence, doc, labels, chosen, start)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = np.where(theta[:-1] == 0, 1e-6, theta[:-1])
    return Model(weights, BIAS, float(sigmoid(theta[-1])))


def _climb(word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, labels: np.ndarray, chosen: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Adam steps up the likelihood: the chosen words' weights and the leak's logit."""
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[word] >= 0
    feature, sentence = number[word[keep]], sentence[keep]
    n, labels = len(labels), labels.astype(float)
    live, sentence = np.unique(sentence, return_inverse=True)
    doc = doc[live]
    theta = np.append(start, -4.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        p = sigmoid(BIAS + np.bincount(sentence, theta[feature], minlength=len(doc)))
        leak = sigmoid(theta[-1])
        clean = (1 - leak) * np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))
        pull = labels * clean / np.maximum(1 - clean, 1e-9) - (1 - labels)
        by_sentence = p * pull[doc]
        slope = np.append(np.bincount(feature, by_sentence[sentence], minlength=len(chosen)), leak * pull.sum()) / n
        slope[:-1] -= SHRINK * np.sign(theta[:-1])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from text and toxic of labelled documents, at most about SAMPLE of them, picked by a hash of doc_id."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = own.count()
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, SAMPLE / max(1, n))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id").select("toxic", "text")
    parts = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_fitted, "bucket long, weight double").collect()
    weights, leak = np.zeros(1 << BITS, np.float32), 0.0
    for r in parts:
        if r["bucket"] < 0:
            leak = r["weight"]
        else:
            weights[r["bucket"]] = r["weight"]
    return Model(weights, BIAS, leak)


def _fitted(table: pa.Table) -> pa.Table:
    """(bucket, weight) of the words that have one; bucket -1 is the leak. For the sample, in one task."""
    toxic: dict[bytes, int] = {}  # copies of a text are one example, not evidence for each other
    for text, label in zip(raw(table.column("text").combine_chunks()), table.column("toxic").to_pylist()):
        toxic[text or b""] = max(label, toxic.get(text or b"", 0))
    texts = sorted(toxic)
    model = fit(texts, np.array([toxic[t] > 0 for t in texts], bool))
    used = np.flatnonzero(model.weights)
    return pa.table({"bucket": pa.array([-1, *used.tolist()], pa.int64()), "weight": pa.array([model.leak, *model.weights[used].tolist()], pa.float64())})


def held_out(column: str) -> F.Column:
    """Rows that nothing is learnt from: crc32 of the id as text mod 4 is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score each whole text and locate its worst sentence.

    Takes doc_id and text (null: empty). Returns text and rest (see unkeyed()), doc_id, score, predicted, n_sentences,
    n_offending (sentences whose own score reaches the threshold) and worst_sentence (number of the first with
    the greatest score, from 0; null without words). A text without words has the
    leak as its score. A row for each row.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for b in batches:
            for i, j, c in chunks(raw(b.column("text"))):
                word, sentence, doc = bags(c)
                p = model.sentences(word, sentence, len(doc))
                n = j - i
                total = model.documents(p, doc, n)
                count = np.bincount(doc, minlength=n)
                first = np.cumsum(count) - count
                order = np.lexsort((np.arange(len(doc)), -p, doc))
                some = count > 0
                worst = np.zeros(n, np.int64)
                worst[some] = order[first[some]] - first[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").slice(i, n), b.column("text").slice(i, n), b.column("rest").slice(i, n),
                        pa.array(np.clip(total, 0, 1)), pa.array(count),
                        pa.array(np.bincount(doc, p >= THRESHOLD, minlength=n).astype(np.int64)), pa.array(worst, mask=~some),
                    ],
                    ["id", "text", "rest", "score", "n_sentences", "n_offending", "worst_sentence"],
                )

    rows = keyed(docs, keep=True).select("id", "text", "rest")
    out = rows.mapInArrow(run, added(rows, "score double, n_sentences long, n_offending long, worst_sentence long"))
    return out.select("text", "rest", doc_id(), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_sentence")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of docs by a model learnt from labels (doc_id, toxic) of the rows that aren't held out; adds held_out.

    Several labels of a document count as the greatest. Without a toxic label among them every score is 0.
    """
    model = learn(docs.filter(~held_out("doc_id")), labels)
    return score(docs, model).withColumn("held_out", held_out("doc_id"))
