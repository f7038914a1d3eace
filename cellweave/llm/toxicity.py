"""Toxicity by multiple-instance learning.

A document is a bag of the sentences that hold a feature. A sentence scores s = sigmoid(bias + weights of its distinct
words' features); the document scores noisy-or, 1 - (1 - sigmoid(bias)) * prod(1 - s): the bias stands once for all that
holds no feature, and a sentence under `FLOOR` counts as clean, so no length of clean text makes a document toxic. Only
document labels are known: the gradient of the document's loss shares the blame among its sentences, which then can be
located. Features are lower-case words and word beginnings of 4 and 5 letters, so that unseen forms of a known stem count.

The model is trained on at most about `max_labels` labelled rows (a documented bound, chosen by a hash of
doc_id) with up to `max_features` features of the strongest association; every whole text is scored.

Nulls: a null or empty text has no sentence and scores 0; rows without a label do not teach; equal texts
teach once; without labels of both kinds every text scores 0. Repeated rows each get a row; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import bounded_labels, checkpoint, slices

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: A document without any feature scores sigmoid of this; a sentence starts from it.
BIAS = -10.0
#: Sentences that score less are clean: they have no part in a document's score.
FLOOR = 0.01
#: Distinct words whose weight a worker keeps.
CACHE_WORDS = 500_000


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float = BIAS


class Scorer(dict):
    """Word -> summed weight of its features."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.silent = math.log1p(math.exp(model.bias))
        self.least = math.log(FLOOR / (1 - FLOOR))

    def __missing__(self, word: str) -> float:
        get = self.model.weights.get
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = w = sum(get(f, 0.0) for f in features_of(word))
        return w

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Spans of the sentences that hold a feature, with their log-odds."""
        out = []
        for m in _SENTENCE.finditer(text):
            total = sum(map(self.__getitem__, set(_WORD.findall(m[0].lower()))))
            if total:
                out.append((m.start(), m.end(), self.model.bias + total))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and its sentences of 0.5 or more."""
        if not text or not self.model.weights:
            return 0.0, []
        # Most texts hold no feature: one look at their words is enough.
        held = self.sentences(text) if any(map(self.__getitem__, _WORD.findall(text.lower()))) else []
        quiet = self.silent + sum(z if z > 30 else math.log1p(math.exp(z)) for _, _, z in held if z >= self.least)
        return -math.expm1(-quiet), [(a, b, 1 / (1 + math.exp(-z))) for a, b, z in held if z >= 0]


def seen_in(text: str) -> set[str]:
    """The features of a text."""
    return {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}


def instances(text: str, number: dict[str, int]) -> list[list[int]]:
    """The feature numbers of each sentence that holds a known feature."""
    held = ([number[f] for w in set(_WORD.findall(m[0].lower())) for f in features_of(w) if f in number] for m in _SENTENCE.finditer(text))
    return [own for own in held if own]


def association(toxic: Column, clean: Column, n1: float, n0: float) -> Column:
    """How strongly a feature speaks for the label: its log odds ratio over classes, weighted by the root of its documents."""
    return F.sqrt(toxic) * F.log((toxic + 0.5) / (n1 + 1) * (n0 + 1) / (clean + 0.5))


class Bags:
    """Labelled documents as flat arrays: the sentence of each feature, the document of each sentence."""

    def __init__(self, y: np.ndarray, bags: list[list[list[int]]], n_features: int):
        self.y, self.n_features = y, n_features
        self.sentence = np.repeat(np.arange(sum(map(len, bags))), [len(own) for held in bags for own in held])
        self.feature = np.asarray([f for held in bags for own in held for f in own], np.int64)
        self.doc = np.repeat(np.arange(len(bags)), [len(held) for held in bags])
        self.balance = np.where(y == 1, (len(y) - y.sum()) / y.sum(), 1.0)

    def loss(self, w: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """The mean loss of the noisy-or scores, toxic documents weighing as much as clean ones, and its gradient."""
        y, n1 = self.y, self.y.sum()
        z = BIAS + np.bincount(self.sentence, w[self.feature], len(self.doc))
        log_clean = -(np.bincount(self.doc, np.logaddexp(0, z), len(y)) + np.log1p(np.exp(BIAS)))
        toxic = np.maximum(-np.expm1(log_clean), 1e-12)
        value = (self.balance * np.where(y == 1, -np.log(toxic), -log_clean)).sum() / len(y) + 0.5 * penalty * (w @ w) / n1
        # The share of blame of a toxic document's sentences: q / (1 - q) of the document times s of the sentence.
        pull = np.where(y == 1, -np.exp(log_clean) / toxic, 1.0) * self.balance
        slope = pull[self.doc] / (1 + np.exp(-z))
        return float(value), np.bincount(self.feature, slope[self.sentence], self.n_features) / len(y) + penalty * w / n1


def optimise(bags: Bags, *, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Noisy-or maximum likelihood by Adam: the weights of the features."""
    w, m1, m2 = np.zeros(bags.n_features), np.zeros(bags.n_features), np.zeros(bags.n_features)
    for t in range(1, rounds + 1):
        grad = bags.loss(w, penalty)[1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w -= 0.2 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, *, max_labels: int = 12_000, max_features: int = 20_000, min_share: float = 0.012, **options: float) -> Model:
    """Train on the rows of docs (doc_id, text) that labels (doc_id, toxic 0/1) marks.

    Features are counted and sentences turned into feature numbers by the executors; the driver receives the
    chosen features and, of at most about max_labels documents, the sentences that hold some.
    """
    known = bounded_labels(labels, "toxic", max_labels)
    # At most about max_labels rows of 12 bytes: a proven bound.
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    texts = checkpoint(texts.groupBy(F.md5("text").alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label")))
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    n1, n0 = float(total["n1"]), float(total["n"] - total["n1"])
    if not n1 or not n0:
        return Model({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], names=["feature", "toxic", "clean"])
            seen.clear()
            return batch

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in seen_in(text):
                    seen.setdefault(f, [0, 0])[int(label)] += 1
                if len(seen) > 500_000:
                    yield out()
        yield out()

    counted = texts.select("text", "label").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    speaks = (F.col("toxic") >= max(3, min_share * n1)) & ((F.col("toxic") + 0.5) / (n1 + 1) > 3 * (F.col("clean") + 0.5) / (n0 + 1))
    chosen = [r["feature"] for r in counted.where(speaks).orderBy(association(F.col("toxic"), F.col("clean"), n1, n0).desc(), "feature").limit(max_features).collect()]
    if not chosen:
        return Model({})
    number = {f: k for k, f in enumerate(chosen)}
    bags = pa.list_(pa.list_(pa.int32()))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [instances(t, number) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1).cast(pa.int32()), pa.array(got, bags)], names=["h", "label", "held"])

    rows = sorted(texts.select("text", "label", "h").mapInArrow(turn, "h string, label int, held array<array<int>>").collect(), key=lambda r: r["h"])
    w = optimise(Bags(np.asarray([r["label"] for r in rows], float), [r["held"] for r in rows], len(chosen)), **options)
    return Model({f: float(w[k]) for f, k in number.items() if abs(w[k]) > 0.05})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the offending sentences (array of start, end in code points, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                got = [scorer.score(t or "") for t in part.column(1).to_pylist()]
                held = [[{"start": a, "end": b, "score": s} for a, b, s in g[1]] for g in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([min(1.0, max(0.0, g[0])) for g in got], pa.float64()), pa.array(held, spans)], names=["doc_id", "score", "offending"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([scorer.score(t or "")[0] < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
