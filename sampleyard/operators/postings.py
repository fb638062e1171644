"""Posting tables: which paths hold an instrument, a genre or three letters in a row.

``terms(axis, term, path, said)`` has a row for each instrument and genre of a tag row, the term in
lower case, ``said`` the row's instruments joined by commas; ``grams(gram, path)`` one for each distinct
run of three characters of the path in lower case.  Sorted by term and gram, a reader skips
what it does not look for.  A filter reads its postings only: it intersects those that the argument's
literal parts name and verifies what is left by the exact predicate, wildcards and all, so it finds what
a scan of the tags finds.

Defined results: a null path has no postings; repeated tag rows and terms count once; an argument without
literal parts (for paths: without three literal characters in a row) is verified against all postings
of its kind; null instruments and genres match nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog

#: Characters of a run.
GRAM = 3
_WILD = re.compile(r"[%_\\]")


def terms_of(tags: DataFrame) -> DataFrame:
    """(axis, term, path, said): a row for each distinct instrument and genre of each path."""
    joined = F.array_join("instruments", ",")
    rows = tags.where(F.col("path").isNotNull())
    # a stored name may hold commas itself: each part is a term; a row without instruments has the empty one, which "%" finds
    instruments = rows.select(F.lit("instrument").alias("axis"), F.explode(F.split(F.lower(joined), ",")).alias("term"), "path", joined.alias("said"))
    genres = rows.select(F.lit("genre").alias("axis"), F.explode("genres.genre").alias("term"), "path").select("axis", F.lower("term").alias("term"), "path", F.col("term").alias("said"))
    return instruments.unionByName(genres.where(F.col("term").isNotNull())).distinct()


def grams_of(tags: DataFrame) -> DataFrame:
    """(gram, path): the distinct runs of three characters of each path, in lower case; of a shorter path the whole of it."""
    low = F.lower("path")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - (GRAM - 1))), lambda at: F.substring(low, at, F.lit(GRAM)))
    return tags.select("path").where(F.col("path").isNotNull()).distinct().select(F.explode(F.array_distinct(runs)).alias("gram"), "path")


def literal_runs(wanted: str) -> list[str]:
    """The distinct runs of three characters that stand in every text that holds ``wanted``."""
    parts = [p for p in _WILD.split(wanted.lower()) if len(p) >= GRAM]
    return list(dict.fromkeys(p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)))


def with_instrument(terms: DataFrame, wanted: str) -> DataFrame:
    """Paths of tag rows for which :func:`sampleyard.operators.catalog.has_instrument` holds."""
    own = terms.where(F.col("axis") == "instrument")
    plain = [p for p in wanted.lower().split(",") if p and not _WILD.search(p)]
    if plain:  # the part of the argument that is a whole term of every row it matches
        own = own.where(F.col("term") == max(plain, key=len))
    return own.where(catalog.has_instrument(F.array("said"), wanted)).select("path").distinct()


def with_genre(terms: DataFrame, wanted: str) -> DataFrame:
    """Paths of tag rows for which :func:`sampleyard.operators.catalog.has_genre` holds."""
    own = terms.where(F.col("axis") == "genre")
    own = own.where(F.col("said").ilike(wanted)) if _WILD.search(wanted) else own.where(F.col("term") == wanted.lower())
    return own.select("path").distinct()


def with_path_like(grams: DataFrame, wanted: str) -> DataFrame:
    """Paths that hold ``wanted`` without regard to case, ``%`` and ``_`` being wildcards."""
    runs = literal_runs(wanted)
    if not runs:
        return grams.select("path").distinct().where(_like(wanted))
    found = grams.where(F.col("gram").isin(runs)).groupBy("path").agg(F.count("*").alias("n"))
    return found.where((F.col("n") == len(runs)) & _like(wanted)).select("path")


def _like(wanted: str) -> Column:
    return F.col("path").ilike(f"%{wanted}%")


def matching(terms: DataFrame, grams: DataFrame, instrument: str | None = None, genre: str | None = None, path_like: str | None = None) -> DataFrame | None:
    """Paths that the given filters all leave; None where none is given."""
    found = [
        *([] if instrument is None else [with_instrument(terms, instrument)]),
        *([] if genre is None else [with_genre(terms, genre)]),
        *([] if path_like is None else [with_path_like(grams, path_like)]),
    ]
    for more in found[1:]:
        found[0] = found[0].join(more, "path", "left_semi")
    return found[0] if found else None
