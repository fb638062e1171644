"""Operator 5: quality classification by supervised subword embeddings.

Tokens (white-space separated, case and marks kept), their character n-grams and a sign for a
token that repeats the one before it are hashed to buckets; each bucket has a learned vector; a
token is the mean of its own vectors and a document the mean of its tokens, and a softmax layer over two classes scores it.  Vectors and
layer are trained together by numpy stochastic gradient descent.  As the layer is linear in the
mean, a token's part of the margin is a single number that workers compute once and remember.

Defined results: a null or empty text has the zero vector and gets the layer's own score; equal
texts get equal scores; labels that are null are not learned from; with no usable label every
score is 0.5; an empty table gives an empty table; whole texts are read, of any length.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, bounded_sample, slices, written

NGRAMS = (3, 4)
REPEAT = "\x00repeat"
CACHE_TOKENS = 400_000


class _Hashed(dict):
    """String -> crc32, remembered; bounded."""

    def __missing__(self, key: str) -> int:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        self[key] = h = zlib.crc32(key.encode("utf-8", "surrogatepass"))
        return h


_NGRAM = _Hashed()


def subwords(token: str, buckets: int) -> list[int]:
    """Buckets of a token and of its character n-grams, its ends marked."""
    if token == REPEAT:
        return [zlib.crc32(b"repeat") % buckets]
    marked = f"<{token}>"
    size, hashed = len(marked), _NGRAM
    out = [zlib.crc32(marked.encode("utf-8", "surrogatepass")) % buckets]
    for n in NGRAMS:
        if n < size:
            out += [hashed[marked[i : i + n]] % buckets for i in range(size - n + 1)]
    return out


def tokens(text: str) -> tuple[list[str], int]:
    """Tokens, and how many equal the one before."""
    found = text.split()
    return found, sum(map(operator.eq, found, found[1:]))


def counted(found: list[str], repeats: int, buckets: int) -> dict[int, float]:
    """Bucket -> its share in the document's mean."""
    bag: Counter = Counter()
    total = len(found) + repeats
    for token, n in [*Counter(found).items(), *([(REPEAT, repeats)] if repeats else [])]:
        ids = subwords(token, buckets)
        for f in ids:
            bag[f] += n / (total * len(ids))
    return bag


@dataclass
class QualityModel:
    vectors: np.ndarray  # buckets x dim
    layer: np.ndarray  # dim x 2
    offset: np.ndarray  # 2

    def __post_init__(self):
        self._known: dict[str, float] = {}
        self._parts: list[float] = []

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_parts": []}

    def compact(self) -> QualityModel:
        """The same scores from one-dimensional vectors: what tasks need."""
        margin = (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)[:, None]
        return QualityModel(margin, np.array([[0.0, 1.0]]), self.offset)

    def _part(self, token: str) -> float:
        if len(self._known) >= CACHE_TOKENS:
            self._known.clear()
        parts = self._parts = self._parts or (self.vectors[:, 0] * self.layer[0, 1]).tolist()
        ids = subwords(token, len(parts))
        self._known[token] = got = sum([parts[i] for i in ids]) / len(ids)
        return got

    def score(self, text: str) -> float:
        """Probability of class 1; of a compact model."""
        found, repeats = tokens(text)
        known, count = self._known, len(found) + repeats
        total = 0.0
        for t in found:
            part = known.get(t)
            total += self._part(t) if part is None else part
        if repeats:
            total += repeats * self._part(REPEAT)
        z = (total / count if count else 0.0) + self.offset[1] - self.offset[0]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> QualityModel:
    """Mini-batch gradient descent (Adagrad steps) on the softmax loss."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = rng.uniform(-1, 1, (dim, 2)).astype(np.float32)
    offset = np.log(np.bincount(labels, minlength=2) / len(labels) + 1e-6)
    seen_v, seen_l, seen_o = np.full(buckets, 1e-8, np.float32), np.full(layer.shape, 1e-4), np.full(2, 1e-2)
    order = np.array([i for i, (ids, _) in enumerate(bags) if len(ids)])
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            sizes = [len(bags[i][0]) for i in part]
            ids = np.concatenate([bags[i][0] for i in part])
            share = np.concatenate([bags[i][1] for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[ids] * share[:, None], starts)
            z = mean @ layer + offset
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p /= len(part)
            g_layer, g_offset, g_mean = mean.T @ p, p.sum(axis=0), (p @ layer.T).astype(np.float32)
            rows, where = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(rows), dim), np.float32)
            spread = np.repeat(g_mean, sizes, axis=0) * share[:, None]
            for d in range(dim):
                grad[:, d] = np.bincount(where, spread[:, d])
            seen_v[rows] += (grad * grad).mean(axis=1)
            vectors[rows] -= rate * grad / np.sqrt(seen_v[rows])[:, None]
            seen_l += g_layer * g_layer
            layer -= (rate * g_layer / np.sqrt(seen_l)).astype(np.float32)
            seen_o += g_offset * g_offset
            offset -= rate * g_offset / np.sqrt(seen_o)
    return QualityModel(vectors, layer, offset)


def fit(
    labelled: DataFrame, text_col: str = "text", label_col: str = "quality", limit: int = 6_000, limit_bytes: int = 64 << 20, buckets: int = 1 << 17, dim: int = 8, epochs: int = 6, rate: float = 0.05, seed: int = 1
) -> QualityModel:
    """Train on about ``limit`` distinct rows of ``labelled`` (text, label) or ``limit_bytes`` bytes of text at most, whole texts.

    Tasks count each document's buckets; only the counts and labels come to the driver.
    """
    rows = bounded_sample(labelled, text_col, label_col, limit, limit_bytes)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 128):
                ids, shares = [], []
                for t in b.column(0).to_pylist():
                    found, repeats = tokens(t or "")
                    bag = counted(found, repeats, buckets)
                    ids.append(np.fromiter(bag.keys(), np.int32, len(bag)).tobytes())
                    shares.append(np.fromiter(bag.values(), np.float32, len(bag)).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["y", "ids", "shares"])

    features_table = written(bounded_batches(rows).mapInArrow(extract, "y int, ids binary, shares binary"), "quality-features")
    # row by row: the driver holds the counts once, as bytes
    got = [(r["y"], bytes(r["ids"]), bytes(r["shares"])) for r in features_table.toLocalIterator()]
    got.sort(key=lambda r: (zlib.crc32(r[1]), r[0]))  # not the order of arrival
    labels = np.array([r[0] for r in got], dtype=np.int64)
    if not len(labels) or labels.min() == labels.max():
        flat = float(labels.mean()) if len(labels) else 0.5
        edge = np.clip(flat, 1e-3, 1 - 1e-3)
        return QualityModel(np.zeros((buckets, 1), np.float32), np.zeros((1, 2)), np.log(np.array([1 - edge, edge])))
    bags = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for _, i, x in got]
    return _train(bags, labels, buckets, dim, epochs, rate, seed)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    small = model.compact()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 512):
                scores = [small.score(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[id_col, "score", "predicted"]
                )

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double, predicted int")
