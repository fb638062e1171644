"""Zero-shot scoring: embeddings against label embeddings, and labels picked from similarities.

The label matrix is a model parameter bounded by the vocabulary.  It travels with the tasks, which multiply it
with an Arrow batch of embeddings at a time; the plan holds one call whatever the embeddings' width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as T
from .names import let, strings


def products(embeddings: pa.Array, labels: np.ndarray) -> pa.Array:
    """A list of dot products with each label for every embedding; null where it is null, holds a null or has another width."""
    lists = embeddings if isinstance(embeddings, pa.ListArray) else embeddings.cast(pa.list_(embeddings.type.value_type))
    known = pc.fill_null(pc.equal(pc.list_value_length(lists), labels.shape[1]), False)
    kept = lists.filter(known)
    values = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, labels.shape[1])
    scores = values @ labels.T
    holes = np.isnan(values).any(axis=1) & np.array([None in v for v in kept.to_pylist()], bool) if kept.flatten().null_count else np.zeros(len(scores), bool)
    there = np.zeros(len(lists), bool)
    there[np.flatnonzero(known.to_numpy(zero_copy_only=False))] = ~holes
    ends = np.concatenate([[0], np.cumsum(np.where(there, labels.shape[0], 0))]).astype(np.int32)
    flat = pa.array(scores[~holes].ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~there))


def similarities(embedding: Column, labels: list[list[float]]) -> Column:
    """ARRAY<DOUBLE> of dot products with each label's embedding."""
    matrix = np.array(labels, dtype=np.float64)

    @F.arrow_udf("array<double>")
    def scores(embeddings: pa.Array) -> pa.Array:
        return products(embeddings, matrix)

    return scores(embedding)


def ranked(scores: Column, names: list[str]) -> Column:
    """ARRAY<STRUCT<score, order, name>>, best first, ties by vocabulary order."""
    pairs = F.zip_with(scores, F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda s, i: F.struct((-s).alias("neg"), i.alias("order")))
    table = strings(names)
    return F.transform(F.array_sort(pairs), lambda p: F.struct((-p["neg"]).alias("score"), p["order"].alias("order"), F.get(table, p["order"]).alias("name")))


def best_label(scores: Column, names: list[str]) -> Column:
    return F.get(ranked(scores, names), F.lit(0))["name"]


def top_labels(scores: Column, names: list[str], ratio: float = T.INSTRUMENT_RATIO, cap: int = T.INSTRUMENT_CAP) -> Column:
    """The best label, and up to ``cap`` in all that score at least ``ratio`` of it."""


    def kept(order: Column) -> Column:
        return let(F.get(order, F.lit(0)), lambda top: F.filter(order, lambda s: (s["score"] >= top["score"] * ratio) | (s["order"] == top["order"])))

    return F.transform(F.slice(let(ranked(scores, names), kept), 1, cap), lambda s: s["name"])


def rank_genres(scores: Column, names: list[str] = T.GENRES, source: str = "clap", cap: int = T.GENRE_CAP, min_probability: float = T.GENRE_MIN_PROBABILITY, min_similarity: float = T.GENRE_MIN_SIMILARITY, temperature: float = T.GENRE_TEMPERATURE) -> Column:
    """Genres by softmax probability; none when the best raw similarity is below the floor."""
    best = F.array_max(scores)
    weights = let(best, lambda top: F.transform(scores, lambda s: F.exp((s - top) / max(temperature, 1e-6))))
    shares = let(weights, lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(w, lambda x: x / total)))
    likely = F.slice(F.filter(ranked(shares, names), lambda s: s["score"] >= min_probability), 1, cap)
    made = F.transform(likely, lambda s: F.struct(s["name"].alias("genre"), F.round(s["score"], 3).alias("score"), F.lit(source).alias("source")))
    return F.when(best >= min_similarity, made).otherwise(F.array().cast("array<struct<genre:string,score:double,source:string>>"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def recognise_embedding(embedding: Column, kind: Column, categories: dict[str, list[list[float]]], instruments: list[list[float]], genres: list[list[float]]) -> Column:
    """The verdict STRUCT of an audio embedding; label embeddings are given by kind, and for instruments and genres."""
    names = {k: T.categories_for(k) for k in categories}
    scored = {k: similarities(embedding, v) for k, v in categories.items()}
    pick = lambda f: F.when(kind == "loop", f("loop")).when(kind == "recording", f("recording")).otherwise(f("one-shot"))
    none = F.array().cast("array<struct<genre:string,score:double,source:string>>")
    return F.when(
        embedding.isNotNull(),
        F.struct(
            pick(lambda k: best_label(scored[k], names[k])).alias("category"),
            top_labels(similarities(embedding, instruments), T.INSTRUMENTS).alias("instruments"),
            F.lit("clap").alias("source"),
            clamp(pick(lambda k: F.array_max(scored[k]))).alias("confidence"),
            F.lit(None).cast("string").alias("caption"),
            F.when(kind.isin("loop", "recording"), rank_genres(similarities(embedding, genres))).otherwise(none).alias("genres"),
        ),
    )
