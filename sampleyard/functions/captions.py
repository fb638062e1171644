"""Scoring of free-text captions against the vocabularies, by whole words."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as T
from .names import let, literal_map, strings


def forms(term: str) -> list[str]:
    return [term, *T.VARIANTS.get(term, ())]


def word_pattern(term: str, prefix: str = "(?U)") -> str:
    """A pattern for a term or any of its surface forms as whole words."""
    every = "|".join(re.escape(f).replace(r"\ ", " ").replace(r"\-", "-").replace(r"\&", "&").replace(r"\'", "'") for f in forms(term))
    return rf"{prefix}\b(?:{every})\b"


def _may_hold(low: Column, term: str) -> Column:
    """Whether the letters of one of the term's forms occur: a plain search that spares most patterns."""
    short = [f for f in forms(term) if not any(g != f and g in f for g in forms(term))]
    return reduce(lambda a, b: a | b, [low.contains(f) for f in short])


def match_terms(caption: Column, vocabulary: list[str]) -> Column:
    """Terms that occur, in the vocabulary's order."""

    def found(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_may_hold(low, t) & low.rlike(word_pattern(t)), t) for t in vocabulary]))

    return let(F.lower(caption), found)


def rank_terms(caption: Column, vocabulary: list[str], by_place: bool = True) -> Column:
    """ARRAY<STRUCT<rank, place, position, term>> of terms that occur: most often, then (``by_place``) earliest, then vocabulary order.

    ``rank`` is minus the number of occurrences.
    """

    def counted(low: Column, i: int, term: str) -> Column:
        pattern = F.lit(word_pattern(term))
        place = F.regexp_instr(low, pattern) if by_place else F.lit(0)
        return F.when(_may_hold(low, term), F.struct((-F.regexp_count(low, pattern)).alias("rank"), place.alias("place"), F.lit(i).alias("position"), F.lit(term).alias("term")))

    def found(low: Column) -> Column:
        return F.array_sort(F.filter(F.array(*[counted(low, i, t) for i, t in enumerate(vocabulary)]), lambda s: s["rank"] < 0))

    return let(F.lower(caption), found)


def rank_categories(caption: Column, kind: Column) -> Column:
    by_kind = {k: rank_terms(caption, v) for k, v in T.CATEGORIES.items()}
    return F.when(kind == "loop", by_kind["loop"]).when(kind == "recording", by_kind["recording"]).otherwise(by_kind["one-shot"])


def genre_shares(top: Column, source: str = "ace-step") -> Column:
    """ARRAY<STRUCT<genre, score, source>> of counted genres, by their share of mentions."""
    total = F.aggregate(top, F.lit(0), lambda n, s: n - s["rank"])
    return let(
        total,
        lambda all_of: F.transform(
            top, lambda s: F.struct(s["term"].alias("genre"), F.round(F.lit(T.GENRE_CAPTION_WEIGHT) * -s["rank"] / all_of, 3).alias("score"), F.lit(source).alias("source"))
        ),
    )


def score_genres(caption: Column, source: str = "ace-step") -> Column:
    """Genres by share of mentions among the top three, ARRAY<STRUCT<genre, score, source>>."""
    return let(F.slice(rank_terms(caption, T.GENRES, by_place=False), 1, T.GENRE_CAP), lambda top: genre_shares(top, source))


def _instrument_table() -> dict[str, str]:
    """'kind|instrument' -> the first of its categories that the kind has."""
    out = {}
    for kind, categories in T.CATEGORIES.items():
        for instrument, candidates in T.INSTRUMENT_CATEGORIES.items():
            valid = [c for c in candidates if c in categories]
            if valid:
                out[f"{kind}|{instrument}"] = valid[0]
    return out


def category_from_instruments(instruments: Column, kind: Column) -> Column:
    """Category of the first instrument that stands for one of the kind's categories."""
    own = F.when(kind.isin("loop", "recording"), kind).otherwise("one-shot")
    table = literal_map(_instrument_table())
    mapped = F.transform(instruments, lambda i: table[F.concat(own, F.lit("|"), i)])
    return F.get(F.filter(mapped, lambda c: c.isNotNull()), F.lit(0))


def placed(caption: Column, kind: Column) -> Column:
    """STRUCT<category, instruments, confidence> of a caption; null for a null or empty one."""
    parts = F.struct(F.get(rank_categories(caption, kind), F.lit(0))["term"].alias("best"), F.slice(match_terms(caption, T.INSTRUMENTS), 1, T.INSTRUMENT_CAP).alias("instruments"))

    def chosen(p: Column) -> Column:
        return let(category_from_instruments(p["instruments"], kind), lambda derived: decided(p["best"], p["instruments"], derived))

    return F.when(F.length(caption) > 0, let(parts, chosen))


def decided(best: Column, instruments: Column, derived: Column) -> Column:
    """STRUCT<category, instruments, confidence>: the best category that is said, else the one the instruments stand for, else the neutral one."""
    return F.struct(
        F.coalesce(best, derived, F.lit(T.NEUTRAL_CATEGORY)).alias("category"),
        instruments.alias("instruments"),
        F.when(best.isNotNull(), T.CAPTION_CONFIDENCE).when(derived.isNotNull(), T.INSTRUMENT_CONFIDENCE).otherwise(T.NEUTRAL_CONFIDENCE).alias("confidence"),
    )


def verdict_of(caption: Column, placed: Column, genres: Column) -> Column:
    """The verdict STRUCT of a caption from what :func:`decided` made of it."""
    return F.struct(
        placed["category"].alias("category"),
        placed["instruments"].alias("instruments"),
        F.lit("ace-step").alias("source"),
        placed["confidence"].alias("confidence"),
        caption.alias("caption"),
        genres.alias("genres"),
    )


def recognise_caption(caption: Column, kind: Column) -> Column:
    """The verdict STRUCT<category, instruments, source, confidence, caption, genres>; null for a null or empty caption."""

    return F.when(F.length(caption) > 0, let(placed(caption, kind), lambda p: verdict_of(caption, p, score_genres(caption))))


__all__ = ["category_from_instruments", "decided", "genre_shares", "match_terms", "placed", "rank_categories", "rank_terms", "recognise_caption", "score_genres", "strings", "verdict_of", "word_pattern"]
