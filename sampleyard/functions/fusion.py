"""Merging several recognisers' verdicts, and fusing them with the name pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as T
from .names import file_name, let, literal_map

GENRE_TYPE = "array<struct<genre:string,score:double,source:string>>"


def dedupe_genres(entries: Column) -> Column:
    """One entry per genre, the highest score (the first of equals), best first; equal scores keep the order of first appearance."""
    return let(entries, _deduped)


def _deduped(entries: Column) -> Column:
    names = F.array_distinct(F.transform(entries, lambda e: e["genre"]))

    def best(name: Column, order: Column) -> Column:
        own = F.filter(entries, lambda e: e["genre"] == name)
        top = F.array_max(F.transform(own, lambda e: e["score"]))
        first = F.get(F.filter(own, lambda e: e["score"] == top), F.lit(0))
        return F.struct((-first["score"]).alias("neg"), order.alias("order"), first.alias("entry"))

    return F.transform(F.array_sort(F.transform(names, best)), lambda s: s["entry"])


def merge(verdicts: Column) -> Column:
    """One verdict of an ARRAY of verdict STRUCTs in run order.

    None: null.  One: itself, unchanged.  More: the category with most votes (two at least; of
    several such the one with the most confident voter, the first of equals), else that of the
    most confident verdict (of equals by precedence of the source); ordered union of instruments,
    keyed union of genres, first caption, highest confidence, sources joined.
    """
    return let(F.filter(verdicts, lambda v: v.isNotNull()), _merged)


def _merged(present: Column) -> Column:
    named = F.array_distinct(F.transform(present, lambda v: v["category"]))

    def vote(category: Column, order: Column) -> Column:
        own = F.filter(present, lambda v: v["category"].eqNullSafe(category))
        return F.struct((-F.size(own)).alias("votes"), (-F.array_max(F.transform(own, lambda v: v["confidence"]))).alias("neg"), order.alias("order"), category.alias("category"))

    top = F.get(F.array_sort(F.transform(named, vote)), F.lit(0))
    precedence = literal_map(T.PRECEDENCE)
    best = F.get(
        F.array_sort(
            F.transform(
                present, lambda v, i: F.struct((-v["confidence"]).alias("neg"), F.coalesce(precedence[v["source"]], F.lit(9)).alias("p"), i.alias("i"), v["category"].alias("category"))
            )
        ),
        F.lit(0),
    )
    captions = F.filter(F.transform(present, lambda v: v["caption"]), lambda c: F.length(c) > 0)

    def merged(chosen: Column) -> Column:
        return F.struct(
            F.when(chosen["votes"] <= -2, chosen["category"]).otherwise(best["category"]).alias("category"),
            F.array_distinct(F.flatten(F.transform(present, lambda v: v["instruments"]))).alias("instruments"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(present, lambda v: v["source"]))), "+").alias("source"),
            F.array_max(F.transform(present, lambda v: v["confidence"])).alias("confidence"),
            F.get(captions, F.lit(0)).alias("caption"),
            dedupe_genres(F.flatten(F.transform(present, lambda v: v["genres"]))).alias("genres"),
        )

    return F.when(F.size(present) == 0, F.lit(None)).when(F.size(present) == 1, F.get(present, F.lit(0))).otherwise(let(top, merged))


def fuse(path: Column, kind: Column, duration: Column, name: Column, verdict: Column, backend: str) -> list[Column]:
    """The columns of a tag row from the name pass and a merged verdict (null: none)."""
    category = F.coalesce(name["category"], verdict["category"])
    union = F.when(verdict.isNotNull(), F.array_union(name["instruments"], verdict["instruments"])).otherwise(name["instruments"])
    confidence = F.greatest(name["confidence"], F.coalesce(verdict["confidence"], F.lit(0.0)))
    return [
        path.alias("path"),
        file_name(path).alias("filename"),
        kind.alias("kind"),
        category.alias("category"),
        F.filter(union, lambda i: ~i.eqNullSafe(category)).alias("instruments"),
        F.coalesce(dedupe_genres(verdict["genres"]), F.array().cast(GENRE_TYPE)).alias("genres"),
        name["key"].alias("key"),
        name["scale"].alias("scale"),
        name["bpm"].alias("bpm"),
        duration.alias("duration"),
        F.bround(confidence, 3).alias("confidence"),
        verdict["caption"].alias("caption"),
        F.lit(backend).alias("backend"),
    ]
