"""Operator 7: toxicity by multiple-instance learning over sentences.

A document is a bag of sentences.  A sentence's probability is a logistic function of its hashed
words and word beginnings; the document's is their noisy-or, 1 - prod(1 - p).  The weights are
trained from document labels alone, by numpy gradient descent on the noisy-or likelihood, so
blame falls on the sentences that explain the label; these are then located as spans.

Defined results: a null or empty text has no sentences and gets the model's base score; equal
texts get equal scores; labels that are null are not learned from; with no usable label every
score is 0; an empty table gives an empty table; whole texts are read, of any length; other
columns pass or are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, bounded_sample, slices, written

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6, 7)
CACHE_WORDS = 262_144


def features(word: str, buckets: int) -> list[int]:
    """Buckets of a lower-cased word and of its beginnings."""
    keys = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(k.encode()) % buckets for k in keys]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence that has words."""
    found = ((m.start(), m.end(), WORD.findall(m.group().lower())) for m in SENTENCE.finditer(text))
    return [s for s in found if s[2]]


class _WordWeights(dict):
    """Word -> summed weights of its features, filled on demand and bounded."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        weights = self.weights
        self[word] = w = sum([weights[f] for f in features(word, len(weights))])
        return w


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    base: float

    def __post_init__(self):
        self._words = None

    def __getstate__(self):
        return {**self.__dict__, "_words": None}

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every sentence."""
        if self._words is None:
            self._words = _WordWeights(self.weights)
        weight, out = self._words.__getitem__, []
        for start, end, words in sentences(text):
            z = sum(map(weight, words), self.bias)
            out.append((start, end, 1 / (1 + exp(-min(max(z, -40.0), 40.0)))))
        return out

    def score(self, spans: list[tuple[int, int, float]]) -> float:
        if not spans:
            return self.base
        clean = np.log1p(-np.minimum(np.array([p for _, _, p in spans]), 1 - 1e-12)).sum()
        return float(min(1.0, max(0.0, 1 - np.exp(clean))))


def _train(ids: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, buckets: int, epochs: int, rate: float, decay: float, seed: int) -> ToxicityModel:
    """Adagrad on the noisy-or likelihood; per document the buckets of all its words, and how many of them each sentence has."""
    rng = np.random.default_rng(seed)
    weights, seen = np.zeros(buckets), np.full(buckets, 1e-2)
    base = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
    bias, seen_bias = -5.0, 1.0
    usable = np.array([i for i, d in enumerate(lengths) if len(d)], dtype=np.int64)
    for _ in range(epochs):
        rng.shuffle(usable)
        for at in range(0, len(usable), 32):
            part = usable[at : at + 32]
            counts = np.array([len(lengths[i]) for i in part])
            offset = np.concatenate([[0], np.cumsum(counts)])
            own = np.concatenate([ids[i] for i in part])
            sent = np.repeat(np.arange(offset[-1]), np.concatenate([lengths[i] for i in part]))
            z = bias + np.bincount(sent, weights[own], minlength=offset[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), offset[:-1]))
            y = labels[part]
            pull = np.where(y == 1, -np.minimum(clean / np.maximum(1 - clean, 1e-6), 50.0), 1.0)
            g_sent = np.repeat(pull, counts) * p / len(part)
            touched, where = np.unique(own, return_inverse=True)
            g = np.bincount(where, g_sent[sent]) + decay * weights[touched]
            seen[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(seen[touched])
            gb = g_sent.sum()
            seen_bias += gb * gb
            bias -= rate * gb / np.sqrt(seen_bias)
    return ToxicityModel(weights.astype(np.float32), float(bias), base)


def bags(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words, number of them in each sentence)."""
    found = [[f for w in words for f in features(w, buckets)] for _, _, words in sentences(text)]
    return np.array([f for s in found for f in s], dtype=np.int32), np.array([len(s) for s in found], dtype=np.int32)


def fit(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", limit: int = 8_000, limit_bytes: int = 64 << 20, buckets: int = 1 << 18, epochs: int = 12, rate: float = 0.5, decay: float = 1e-5, seed: int = 1
) -> ToxicityModel:
    """Train on about ``limit`` distinct rows of ``labelled`` (text, label) or ``limit_bytes`` bytes of text at most, whole texts.

    The sentences' buckets are computed by the tasks; only they and the labels come to the driver.
    """
    rows = bounded_sample(labelled, text_col, label_col, limit, limit_bytes)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 256):
                out = [bags(t or "", buckets) for t in b.column(0).to_pylist()]
                columns = [pa.array([o[i].tobytes() for o in out], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(1), *columns], names=["y", "ids", "lengths"])

    features_table = written(bounded_batches(rows).mapInArrow(extract, "y int, ids binary, lengths binary"), "toxicity-features")
    # row by row: the driver holds the buckets once, as bytes
    got = [(r["y"], bytes(r["ids"]), bytes(r["lengths"])) for r in features_table.toLocalIterator()]
    got.sort(key=lambda r: (zlib.crc32(r[1]), r[0]))  # not the order of arrival
    labels = np.array([r[0] for r in got], dtype=np.int64)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(np.zeros(buckets, np.float32), -40.0, float(labels.mean()) if len(labels) else 0.0)
    ids, lengths = ([np.frombuffer(r[i], np.int32) for r in got] for i in (1, 2))
    return _train(ids, lengths, labels, buckets, epochs, rate, decay, seed)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted, offending array<struct<start, end, p>>): the last are the sentences at or above the threshold,
    or the worst one where only their union reaches it."""
    id_type = docs.schema[id_col].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 512):
                scores, found = [], []
                for t in b.column(1).to_pylist():
                    spans = model.spans(t or "")
                    scores.append(model.score(spans))
                    bad = [s for s in spans if s[2] >= threshold]
                    if scores[-1] >= threshold and not bad and spans:
                        bad = [max(spans, key=lambda s: s[2])]
                    found.append([{"start": a, "end": z, "p": float(p)} for a, z, p in bad])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, span_type)],
                    names=[id_col, "score", "predicted", "offending"],
                )

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int, offending array<struct<start:int,end:int,p:double>>")


def clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 256):
                keep = [model.score(model.spans(t or "")) < threshold for t in b.column(b.schema.names.index(text_col)).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
