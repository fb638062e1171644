"""The name pass over a library: each distinct path part is parsed once, whatever the number of files below it.

Files share their folders.  The distinct folders of a table of files are split into parts, the distinct
parts parsed by plain columns (so in generated code), and a folder's verdict is an ordered
aggregate over its parts: of each cue the value at the greatest depth that has one.  A file then has
its own stem's cues or, where it has none, its folder's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import taxonomy as T
from ..sources.shared import dealt

_CUES = ("kind", "label", "bpm", "key")


def parsed(texts: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """``texts`` with the cues of one column: kind, label, bpm and key (STRUCT<key, scale, confidence>) under ``prefix``."""
    text, low = F.col(text_col), F.col("__low")
    cues = {"kind": names.parse_kind(text, low), "label": names.parse_category(text, low), "bpm": names.parse_bpm(text), "key": names.parse_key(text)}
    return texts.withColumn("__low", F.lower(text)).select("*", *(c.alias(prefix + cue) for cue, c in cues.items())).drop("__low")


def _certain(key: Column) -> Column:
    return key["confidence"] == T.KEY_SCALE_CONFIDENCE


def folder_cues(folders: DataFrame) -> DataFrame:
    """``folders(folder)``, each once, with the cues nearest to a file in it; ``folder_certain``: its nearest key that says a scale."""
    parts = folders.select("folder", F.posexplode(F.split("folder", "/")).alias("depth", "part")).where("part <> ''")
    dictionary = parsed(parts.select("part").distinct(), "part", "part_")
    deepest = lambda cue, there: F.max_by(f"part_{cue}", F.when(there, F.col("depth")))
    found = [deepest(c, F.col(f"part_{c}").isNotNull()).alias(f"folder_{c}") for c in _CUES]
    return parts.join(dictionary, "part").groupBy("folder").agg(*found, deepest("key", _certain(F.col("part_key"))).alias("folder_certain"))


def with_names(files: DataFrame, path_col: str = "path", name: str = "name") -> DataFrame:
    """``files`` with the STRUCT of :func:`sampleyard.functions.names.classify_name` as column ``name``.

    ``files`` is read twice (its folders, then its rows), so it should be a table or checkpointed.
    """
    path = F.col(path_col)
    rows = dealt(files).withColumn("__folder", F.regexp_replace(path, "[^/]*$", "")).withColumn("__stem", names.stem(names.file_name(path)))
    cues = folder_cues(files.select(F.regexp_replace(path, "[^/]*$", "").alias("folder")).where("folder <> ''").distinct())
    cues = cues.select(F.col("folder").alias("__folder"), *(F.col(c).alias(f"__{c}") for c in cues.columns[1:]))
    found = parsed(rows.join(cues, "__folder", "left"), "__stem", "__own_")
    own, folder = F.col("__own_key"), F.col("__folder_key")
    either = {c: F.coalesce(f"__own_{c}", f"__folder_{c}").alias(f"__{c}") for c in _CUES[:3]}
    best = F.coalesce(F.when(_certain(own), own), F.col("__folder_certain"), own, folder).alias("__key")
    said = names.cue_text(names.fragments(path)).alias("__said")  # where a vocal's subtype is looked for
    found = found.select(*files.columns, *either.values(), best, said)
    return found.select(*files.columns, names.verdict(*(F.col(f"__{c}") for c in _CUES), F.col("__said")).alias(name))
