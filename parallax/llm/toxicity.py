"""Toxicity by multiple-instance learning.

Only documents are labelled, but what offends is a sentence. A sentence's probability
is a logistic function of the words and stems in it; a document's is the noisy-or of its
sentences', 1 - prod(1 - p). Both are learned together from the document labels by
gradient descent on the documents' log loss, so the weight of a document's label
goes to the sentences that explain it; the same scores then locate them.

The model is fitted on a sample of at most ``most_documents`` labelled documents of at most
``most_chars`` characters, those with the smallest hash of their id; it takes their whole
texts. Scoring reads whole texts of all documents.

Null texts count as empty and score by the bias alone (no sentence: 0). Labels that are
null are not learned from. A key counts as one document however often it stands in the tables:
one of its texts is learned from, with both labels by their shares where its labels differ.
Without any labelled document the score is 0 everywhere. Every input row gets its own
result row; empty tables give empty results.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import whole_text

MOST_DOCUMENTS = 4000
MOST_CHARS = 20_000
LEAST_DOCUMENTS = 3  # documents a word or stem must be in to become a feature
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W_]+")
MOST_CACHED = 500_000  # words whose weight a task remembers
STEMS = (4, 5)  # prefix lengths that are features beside the word itself


def sentences_of(text: str) -> list[tuple[int, int]]:
    """[start, end) of every sentence, in code points."""
    return [m.span() for m in SENTENCE.finditer(text) if not m.group().isspace()]


def features_of(word: str) -> list[str]:
    """A word, and its stems as prefixes (inflected languages)."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


def words_of(sentence: str) -> list[str]:
    """Distinct words by first appearance, an order that is the same in every process."""
    return list(dict.fromkeys(WORD.findall(sentence.lower())))


class WordWeights(dict):
    """word > sum of its features' weights, filled on demand and bounded."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MOST_CACHED:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return value


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts with a model; one per task, for its cache of words."""

    def __init__(self, model: Model):
        self.bias, self.words = model.bias, WordWeights(model.weights)

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of its sentences above one half."""
        spans = sentences_of(text)
        if not spans:
            return 0.0, []
        value = self.words.__getitem__
        odds = np.array([self.bias + sum(map(value, words_of(text[a:b]))) for a, b in spans])
        worst = [(a, b, float(1 / (1 + np.exp(-z)))) for (a, b), z in zip(spans, odds.tolist()) if z > 0]
        return float(-np.expm1(-np.logaddexp(0, odds).sum())), worst


NO_MODEL = Model(-np.inf, {})


def fit(texts: Sequence[str], labels: Sequence[int], weights: Sequence[float] | None = None, *,
        rounds: int = 150, rate: float = 0.2, shrink: float = 1e-4) -> Model:
    """Noisy-or over sentences, by Adam on the mean log loss of the documents.

    Words can only speak for an offence, never against one: weights stay at zero or above,
    and ``shrink`` takes a constant off them, which clears those that explain little.
    ``weights`` say how much each example counts in the mean.
    """
    in_docs: Counter[str] = Counter()
    for t in texts:
        in_docs.update({f for a, b in sentences_of(t) for w in words_of(t[a:b]) for f in features_of(w)})
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in in_docs.items() if n >= LEAST_DOCUMENTS))}
    keep = [i for i, t in enumerate(texts) if sentences_of(t)]
    y = np.array([labels[i] for i in keep], float)
    share = np.ones(len(y)) if weights is None else np.array([weights[i] for i in keep], float)
    if not len(y) or y.min() == y.max():
        return NO_MODEL if not len(y) or not y.max() else Model(0.0, {})
    word, sentence, doc = array("i"), array("i"), array("i")
    for d, i in enumerate(keep):
        for a, b in sentences_of(texts[i]):
            ids = [vocabulary[f] for w in words_of(texts[i][a:b]) for f in features_of(w) if f in vocabulary]
            word.extend(ids)
            sentence.extend([len(doc)] * len(ids))
            doc.append(d)
    word, sentence, doc = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (word, sentence, doc))
    w = np.zeros(len(vocabulary) + 1)
    w[-1] = -5.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        odds = w[-1] + np.bincount(sentence, w[word], len(doc))
        # log(1 - p) of a document is the sum of its sentences' log(1 - p)
        none = np.bincount(doc, -np.logaddexp(0, odds), len(y))
        clean = np.exp(none)
        # d loss / d log(1 - p): 1 - 1 / p for toxic documents, else 1; the sentence's odds enter it as -p
        push = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) * share / share.sum()
        by_odds = push[doc] / (1 + np.exp(-odds))
        grad = np.concatenate((np.bincount(word, by_odds[sentence], len(vocabulary)), [by_odds.sum()]))
        grad[:-1] += shrink
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad ** 2
        w -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])
    return Model(float(w[-1]), {v: float(w[i]) for v, i in vocabulary.items() if abs(w[i]) > 1e-3})


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
                    usable: Column | None = None, most_documents: int = MOST_DOCUMENTS,
                    most_chars: int = MOST_CHARS) -> DataFrame:
    """(text, label) of the sample, one row per key; the label is the share of its labels above 0.
    Picked from the labels first, so that at most ``most_documents`` keys are joined to the documents.
    Copies of a key are combined before the limit, so they take no other document's place."""
    picked = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
    picked = picked.where(F.col("key").isNotNull() & F.col("label").isNotNull())
    if usable is not None:
        picked = picked.where(usable)
    picked = picked.groupBy("key").agg(F.avg((F.col("label") > 0).cast("double")).alias("label"))
    picked = picked.orderBy(F.xxhash64("key"), "key").limit(most_documents)
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    rows = rows.where(F.length("text") <= most_chars).join(F.broadcast(picked), "key")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    rows = rows.groupBy("key", "label").agg(first.alias("first"))
    return rows.orderBy(F.xxhash64("key"), "key").select("first.text", "label")


def fit_sample(sample: DataFrame, **options) -> Model:
    """The model of a bounded sample, fitted on the driver."""
    rows = [(r["text"], r["label"]) for r in sample.collect()]
    examples = [(t, y, share) for t, label in rows for y, share in ((1, label), (0, 1 - label)) if share > 0]
    return fit([t for t, _, _ in examples], [y for _, y, _ in examples], [w for _, _, w in examples], **options)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``score`` and ``sentences``: start, end (code points) and probability of those above one half."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scored(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            scores, found = [], []
            for t in batch.column(1):
                score, worst = scorer.score(t.as_py())
                scores.append(score)
                found.append([{"start": a, "end": b, "score": p} for a, b, p in worst])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)],
                                             names=["key", "score", "sentences"])

    out = rows.mapInArrow(scored, f"key {rows.schema['key'].dataType.simpleString()}, score double, "
                                  "sentences array<struct<start:bigint,end:bigint,score:double>>")
    return out.withColumnRenamed("key", key)
