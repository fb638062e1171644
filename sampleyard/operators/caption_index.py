"""Captions scored through a positional index of their words.

A caption in lower case is cut at word boundaries into words and what stands between them.  Each word is joined
with the surface forms that begin with it (a small table of the vocabularies), and a form of several pieces
is compared with the pieces that follow.  So one pass finds all terms of all vocabularies: how often and
where first, counted by one aggregation, without a pattern for each term.

Forms begin and end with a word.  Places of one term are counted from the left: of forms that begin at one place the
first listed counts, and places inside a counted one do not, as a search for whole words would.

Defined results: a null or empty caption has no terms and a null verdict; keys must be unique; a row with
a null key has no terms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions as scoring
from ..functions import taxonomy as T

_FORMS = "first string, pieces array<string>, vocabulary string, position int, term string, listed int"


def pieces_of(text: str) -> list[str]:
    """Words and what is between them."""
    return re.findall(r"\w+|\W+", text)


def form_rows() -> list[tuple]:
    """(first word, pieces, vocabulary, place of the term in it, term, place of the form in the term's list) of every surface form."""
    vocabularies = {"instrument": T.INSTRUMENTS, "genre": T.GENRES} | {f"category {kind}": terms for kind, terms in T.CATEGORIES.items()}
    every = [(name, at, term, k, pieces_of(f)) for name, terms in vocabularies.items() for at, term in enumerate(terms) for k, f in enumerate(scoring.forms(term))]
    return [(pieces[0], pieces, name, at, term, k) for name, at, term, k, pieces in every]


def _forms(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(form_rows(), _FORMS))  # some hundred rows, bounded by the vocabularies


def own_vocabulary(kind: Column) -> Column:
    return F.concat(F.lit("category "), F.when(kind.isin("loop", "recording"), kind).otherwise("one-shot"))


def term_counts(captions: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, vocabulary, position, term, n, place) of ``captions(key, kind, caption)``: every term that occurs, how often and at which piece first.

    Of the category vocabularies only that of the caption's kind counts.
    """
    cut = F.split(F.lower("caption"), r"(?U)\b")
    words = captions.where(F.col(key).isNotNull()).select(key, own_vocabulary(F.col("kind")).alias("own"), cut.alias("said")).select(key, "own", "said", F.posexplode("said").alias("at", "word"))
    met = words.join(_forms(captions.sparkSession), F.col("word") == F.col("first"))
    here = (F.size("pieces") == 1) | (F.slice("said", F.col("at") + 1, F.size("pieces")) == F.col("pieces"))
    counts = F.col("vocabulary").isin("instrument", "genre") | (F.col("vocabulary") == F.col("own"))
    places = F.array_sort(F.collect_set(F.struct("at", "listed", F.size("pieces").alias("size"))))  # in one caption
    found = met.where(here & counts).groupBy(key, "vocabulary", "position", "term").agg(places.alias("places"))
    start = F.struct(F.lit(0).alias("free"), F.lit(0).alias("n"))
    counted = F.aggregate("places", start, lambda s, p: F.when(p["at"] >= s["free"], F.struct((p["at"] + p["size"]).alias("free"), (s["n"] + 1).alias("n"))).otherwise(s))
    n = F.when(F.size("places") == 1, 1).otherwise(counted["n"])
    return found.select(key, "vocabulary", "position", "term", n.alias("n"), F.get("places", F.lit(0))["at"].alias("place"))


def with_terms(captions: DataFrame, key: str = "file_id", prefix: str = "") -> DataFrame:
    """``captions`` with ``ranking``, ``instruments`` and ``genre_counts`` (after ``prefix``): what occurs of each vocabulary.

    ``ranking`` is ARRAY<STRUCT<rank, place, position, term>> of categories, most often and earliest first (``rank`` is
    minus the count), ``instruments`` all in the vocabulary's order, ``genre_counts`` the most frequent ones of ``GENRE_CAP``.
    """
    found = term_counts(captions, key)
    of = lambda where, entry: F.array_sort(F.collect_list(F.when(where, entry)))
    category = F.col("vocabulary").startswith("category")
    rank = -F.col("n")
    lists = found.groupBy(F.col(key).alias("__of")).agg(
        of(category, F.struct(rank.alias("rank"), "place", "position", "term")).alias("__found_categories"),
        of(F.col("vocabulary") == "instrument", F.struct("position", "term")).alias("__found_instruments"),
        of(F.col("vocabulary") == "genre", F.struct(rank.alias("rank"), F.lit(0).alias("place"), "position", "term")).alias("__found_genres"),
    )
    entries = "array<struct<rank:int,place:int,position:int,term:string>>"
    return captions.join(lists, F.col(key) == F.col("__of"), "left").select(
        *captions.columns,
        F.coalesce("__found_categories", F.array().cast(entries)).alias(f"{prefix}ranking"),
        F.coalesce(F.col("__found_instruments.term"), F.array().cast("array<string>")).alias(f"{prefix}instruments"),
        F.coalesce(F.slice("__found_genres", 1, T.GENRE_CAP), F.array().cast(entries)).alias(f"{prefix}genre_counts"),
    )


def with_verdicts(captions: DataFrame, key: str = "file_id", name: str = "verdict") -> DataFrame:
    """``captions(key, kind, caption, ...)`` with the STRUCT of :func:`sampleyard.functions.captions.recognise_caption`."""
    found = with_terms(captions, key, prefix="__")
    best, some = F.get("__ranking", F.lit(0))["term"], F.slice("__instruments", 1, T.INSTRUMENT_CAP)
    placed = scoring.decided(best, some, scoring.category_from_instruments(some, F.col("kind")))
    made = scoring.verdict_of(F.col("caption"), placed, scoring.genre_shares(F.col("__genre_counts")))
    return found.select(*captions.columns, F.when(F.length("caption") > 0, made).alias(name))
