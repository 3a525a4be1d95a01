"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Rows the model is fitted on at most, chosen by a hash of their id; all others are only scored.
TRAIN_ROWS = 6_000
BUCKETS = 1 << 18
DIM = 4
#: Training documents a subword must be in to get an embedding of its own.
LEAST_DOCS = 10
#: Factor of the averages, so that a few words among hundreds count.
SCALE = 32
#: Share of the larger first gradients below which a step follows the gradient, not its sign alone.
FLOOR = 0.1
#: Training documents a word must be in for its subwords to learn from it.
LEAST_WORD = 2
LENGTHS = (3, 4, 5)
EPOCHS = 45
_WORD = re.compile(r"[^\W_]+")
_REMEMBERED = 300_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, with marks for its ends."""
    marked = f"<{word}>"
    grams = {marked, *(marked[i:i + n] for n in LENGTHS for i in range(len(marked) - n + 1))}
    return [zlib.crc32(g.encode("utf-8")) % BUCKETS for g in sorted(grams)]


@dataclass
class Model:
    """``weight`` is each bucket's embedding times the difference of the two softmax columns:
    the average over a text's words of the average over a word's subwords is its logit."""

    weight: np.ndarray
    bias: float


class _Bags:
    """Sparse averaging matrix as flat (row, column) pairs; each row is the mean of its columns' vectors."""

    def __init__(self, lists: list[list[int]], columns: int, counted: list[int] | None = None):
        sizes = np.array([len(x) for x in lists], np.int64)
        self.rows, self.columns = len(lists), columns
        self.of = np.repeat(np.arange(len(lists)), sizes)
        self.items = np.concatenate([np.array(x, np.int64) for x in lists if x]) if sizes.sum() else np.zeros(0, np.int64)
        self.scale = (1 / np.maximum(sizes if counted is None else np.array(counted), 1)).astype(np.float32)
        self.back = np.argsort(self.items, kind="stable")

    def lists(self) -> list[np.ndarray]:
        return [np.unique(x) for x in np.split(self.items, np.flatnonzero(np.diff(self.of)) + 1) if len(x)]

    def forward(self, vectors: np.ndarray) -> np.ndarray:
        return _summed(vectors[self.items], self.of, self.rows) * self.scale[:, None]

    def backward(self, grads: np.ndarray) -> np.ndarray:
        scaled = grads * self.scale[:, None]
        return _summed(scaled[self.of[self.back]], self.items[self.back], self.columns)


def _summed(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by sorted group."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(groups):
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        out[groups[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 1) -> Model:
    """Embeddings and softmax fitted together by Adam on all rows at once.

    Without examples of both classes, or without a subword in enough of them, the model
    scores every text by its prior.
    """
    labels = np.asarray(labels, np.int64)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    flat = Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    if len(labels) == 0 or labels.min() == labels.max():
        return flat
    numbers: dict[str, int] = {}
    docs = _Bags([[numbers.setdefault(w, len(numbers)) for w in words_of(t)] for t in texts], 0)
    docs.columns = len(numbers)
    grams = [np.array(subwords(w), np.int64) for w in numbers]
    per_doc = docs.lists()
    spread = np.bincount(np.concatenate(per_doc) if per_doc else np.zeros(0, np.int64), minlength=len(numbers))
    grams = [g if n >= LEAST_WORD else g[:0] for g, n in zip(grams, spread.tolist(), strict=True)]
    seen = np.zeros(BUCKETS, np.int64)
    for mine in per_doc:
        seen[np.unique(np.concatenate([grams[w] for w in mine]))] += 1
    used = np.flatnonzero(seen >= LEAST_DOCS)
    if not len(used):
        return flat
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    sizes = [len(g) for g in grams]
    words = _Bags([[k for k in place[g].tolist() if k >= 0] for g in grams], len(used), sizes)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    states = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, softmax, bias)]
    floors = [0.0] * 3
    for step in range(1, epochs + 1):
        hidden = docs.forward(words.forward(table)) * SCALE
        logits = hidden @ softmax + bias
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        error = (chance - target) / len(labels)
        grads = [words.backward(docs.backward(error @ softmax.T * SCALE)), hidden.T @ error, error.sum(axis=0)]
        for k, (p, g, (m, v)) in enumerate(zip((table, softmax, bias), grads, states, strict=True)):
            if step == 1:
                floors[k] = FLOOR * float(np.quantile(np.abs(g), 0.99)) + 1e-12
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + floors[k])
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = table @ (softmax[:, 1] - softmax[:, 0]) * SCALE
    return Model(weight, float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    """Whether the checksum of the id's text leaves no remainder by five."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text",
                  label: str = "toxic") -> DataFrame:
    """At most ``rows`` labelled rows that are not held out: a third of them of label 1 while
    there are enough, each part in the order of a hash of the id, so the choice is no accident
    of partitions. A document labelled twice counts by its largest label."""
    known = pick(labels, doc_id=key, label=label).where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    mixed = F.xxhash64(F.lit("train"), "doc_id")
    chosen = known.where("label > 0").orderBy(mixed).limit(rows // 3).union(known.where("label <= 0").orderBy(mixed).limit(rows - rows // 3))
    return pick(docs, doc_id=key, text=text).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **columns: str) -> Model:
    """The model of a bounded sample of labelled rows, fitted on the driver."""
    sample = training_rows(docs, labels, rows, **columns).orderBy("doc_id").limit(2 * rows).collect()
    return train([r["text"] or "" for r in sample], np.array([int(r["label"] > 0) for r in sample]))


class Scorer:
    """Scores texts with the values of words and of n-grams met before kept at hand, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, float] = {}
        self.grams: dict[str, float] = {}

    def word(self, word: str) -> float:
        marked, known, total = f"<{word}>", self.grams, 0.0
        n = len(marked)
        grams = {marked}
        for size in LENGTHS:
            grams.update([marked[i:i + size] for i in range(n - size + 1)])
        for gram in grams:
            value = known.get(gram)
            if value is None:
                value = float(self.model.weight[zlib.crc32(gram.encode("utf-8")) % BUCKETS])
                if len(gram) <= LENGTHS[-1]:
                    known[gram] = value
            total += value
        return total / len(grams)

    def score(self, text: str | None) -> float:
        words = words_of(text)
        if not words:
            return self._chance(self.model.bias)
        known, total = self.words, 0.0
        for word in words:
            value = known.get(word)
            if value is None:
                value = known[word] = self.word(word)
            total += value
        for memory in (self.words, self.grams):
            if len(memory) > _REMEMBERED:
                memory.clear()
        return self._chance(total / len(words) + self.model.bias)

    @staticmethod
    def _chance(logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text alone.

    Null and empty texts get the score of no evidence, below one half. Repeated texts score alike.
    """
    rows = pick(docs, doc_id=key, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in parts:
            scores = [scorer.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    found = rows.mapInArrow(batches, f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
