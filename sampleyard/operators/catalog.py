"""Catalog operators as pure DataFrame functions: filtered reads, upserts, edits, deletes, collections.

They take tables and return tables; :mod:`sampleyard.sources.catalog` keeps them in snapshots.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.errors import BadInputError

GENRES_DDL = "array<struct<genre:string,score:double,source:string>>"
TAGS_DDL = (
    "path string, filename string, kind string, category string, instruments array<string>, "
    f"genres {GENRES_DDL}, key string, scale string, bpm double, duration double, confidence double, "
    "caption string, backend string, mtime double, scanned_at double, edited boolean"
)
_GENRES_TYPE = T.ArrayType(T.StructType([T.StructField("genre", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("source", T.StringType())]))
_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}
#: Built without a session, so that the module can be imported before there is one.
TAGS_SCHEMA = T.StructType([T.StructField(n, _GENRES_TYPE if n == "genres" else _TYPES[t]) for n, t in (c.split(" ") for c in TAGS_DDL.split(", "))])
COLLECTIONS_DDL = "id long, name string, created_at double"
MEMBERS_DDL = "collection_id long, path string, added_at double"
EDITABLE = ["filename", "kind", "category", "instruments", "genres", "key", "scale", "bpm", "duration", "confidence", "caption", "backend"]
ORDERS = ["path", "filename", "category", "kind", "bpm", "confidence", "scanned_at"]
EQUALITY = ["category", "kind", "key", "scale", "backend"]


def genres_to_json(genres: Column) -> Column:
    return F.to_json(genres)


def genres_from_json(text: Column) -> Column:
    """Stored genres; anything that is not a list of objects is an empty list."""
    return F.coalesce(F.from_json(text, GENRES_DDL, {"mode": "PERMISSIVE"}), F.array().cast(GENRES_DDL))


def instruments_from_text(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def migrated(table: DataFrame, schema: T.StructType = TAGS_SCHEMA) -> DataFrame:
    """The table with columns that older files lack, typed and with their defaults (edited: false, genres: none)."""
    defaults = {"edited": F.lit(False), "genres": F.array().cast(GENRES_DDL)}
    have = set(table.columns)
    return table.select(*[(F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.fields])


def has_instrument(instruments: Column, wanted: str) -> Column:
    """Whole-element match without case; ``%`` and ``_`` in the argument are wildcards."""
    return F.concat(F.lit(","), F.array_join(instruments, ","), F.lit(",")).ilike(f"%,{wanted},%")


def has_genre(genres: Column, wanted: str) -> Column:
    return F.exists(genres, lambda g: g["genre"].ilike(wanted))


def conditions(*, instrument=None, genre=None, bpm_min=None, bpm_max=None, path_like=None, edited=None, **equal) -> list[Column]:
    """The predicates of the given filters; those that are None are left out."""
    unknown = set(equal) - set(EQUALITY)
    if unknown:
        raise BadInputError(f"unknown filter {', '.join(sorted(unknown))}")
    out = [F.col(k) == v for k, v in equal.items() if v is not None]
    if instrument is not None:
        out.append(has_instrument(F.col("instruments"), instrument))
    if genre is not None:
        out.append(has_genre(F.col("genres"), genre))
    if bpm_min is not None:
        out.append(F.col("bpm") >= bpm_min)
    if bpm_max is not None:
        out.append(F.col("bpm") <= bpm_max)
    if path_like is not None:
        out.append(F.col("path").ilike(f"%{path_like}%"))
    if edited is not None:
        out.append(F.col("edited") == bool(edited))
    return out


def query_string_filters(query: dict[str, str]) -> dict:
    """Typed filters from string parameters, as a serving layer gets them."""
    out: dict = {k: query[k] for k in (*EQUALITY, "instrument", "genre", "path_like", "collection", "order") if k in query}
    out |= {k: float(query[k]) for k in ("bpm_min", "bpm_max") if k in query}
    if "limit" in query:
        out["limit"] = int(query["limit"])
    if "edited" in query:
        out["edited"] = query["edited"].lower() not in ("0", "false", "no", "")
    return out


def query(tags: DataFrame, *, collection: DataFrame | None = None, order: str = "path", limit: int | None = None, **filters) -> DataFrame:
    """Tag rows for which all filters hold, in order; ``collection`` is a table of member paths (semi-join)."""
    if order not in ORDERS:
        raise BadInputError(f"order must be one of {', '.join(ORDERS)}")
    found = tags
    for c in conditions(**filters):
        found = found.where(c)
    if collection is not None:
        found = found.join(collection.select("path"), "path", "left_semi")
    found = found.orderBy(F.col(order).asc_nulls_first(), *([] if order == "path" else ["path"]))
    return found.limit(limit) if limit is not None and limit >= 0 else found


def fresh(files: DataFrame, tags: DataFrame, accept: list[str], rescan: bool = False, also: dict[str, str] | None = None) -> DataFrame:
    """``files(path, mtime, ...)`` with ``cached``: known, and edited or unchanged and made by an accepted backend.

    ``also`` names further columns of ``tags`` that come along by the one join, and what to call them.
    """
    known = tags.select("path", *(F.col(c).alias(name) for c, name in (also or {}).items()), F.col("mtime").alias("__mtime"), F.col("backend").alias("__backend"), F.col("edited").alias("__edited"), F.lit(True).alias("__known"))
    same = F.col("mtime").isNotNull() & (F.col("mtime") == F.col("__mtime")) & F.col("__backend").isin(accept)
    cached = F.coalesce(F.col("__known") & (F.coalesce("__edited", F.lit(False)) | F.coalesce(same, F.lit(False))), F.lit(False)) & F.lit(not rescan)
    return files.join(known, "path", "left").withColumn("cached", cached).drop("__mtime", "__edited", "__known").withColumnRenamed("__backend", "cached_backend")


def upsert(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of their path in all columns but ``edited``; of several for a path the last by mtime counts."""
    last = F.struct(F.coalesce("mtime", F.lit(float("-inf"))), F.coalesce("scanned_at", F.lit(0.0)), F.xxhash64(*new.columns)) if {"mtime", "scanned_at"} <= set(new.columns) else F.xxhash64(*new.columns)
    new = new.groupBy(F.col("path").alias("__path")).agg(F.max_by(F.struct(*new.columns), last).alias("__row")).select("__row.*")
    edits = tags.select("path", F.col("edited").alias("__edited"))
    rest = [c for c in tags.columns if c != "edited"]
    merged = new.join(edits, "path", "left").select(*rest, F.coalesce("__edited", F.lit(False)).alias("edited"))
    return tags.join(new.select("path"), "path", "left_anti").select(*rest, "edited").unionByName(merged)


def checked_fields(fields: dict) -> dict:
    if not fields:
        raise BadInputError("nothing to update")
    unknown = set(fields) - set(EDITABLE)
    if unknown:
        raise BadInputError(f"cannot edit {', '.join(sorted(unknown))}")
    return fields


def update(tags: DataFrame, path: str, fields: dict, now: float) -> DataFrame:
    """Sets the given columns of one path, creating its row where absent, and marks it edited."""
    checked_fields(fields)
    spark = tags.sparkSession
    types = {f.name: f.dataType for f in TAGS_SCHEMA.fields}
    values = {k: F.lit(v).cast(types[k]) if not isinstance(v, list) else F.from_json(F.lit(__import__("json").dumps(v)), types[k]) for k, v in fields.items()}
    stamp = {"edited": F.lit(True), "scanned_at": F.lit(float(now))}
    hit = F.col("path") == path
    edited = tags.select(*[F.when(hit, (values | stamp)[c]).otherwise(F.col(c)).alias(c) if c in values or c in stamp else F.col(c) for c in tags.columns])
    default = {"path": F.lit(path), "filename": F.lit(path.rsplit("/", 1)[-1]), "instruments": F.array().cast("array<string>"), "genres": F.array().cast(GENRES_DDL)}
    fresh_row = spark.range(1).select(*[(default | values | stamp).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TAGS_SCHEMA.fields])
    return edited.unionByName(fresh_row.join(tags.where(hit).select("path"), "path", "left_anti").select(*tags.columns))


def normalised(rows: DataFrame, normal: Callable[[str], str]) -> DataFrame:
    """``rows`` with each path as ``normal`` makes it; null ones are left out."""
    return rows.where(F.col("path").isNotNull()).withColumn("path", F.udf(lambda p: normal(p), "string")("path"))


def update_all(tags: DataFrame, edits: DataFrame, now: float) -> DataFrame:
    """The table form of :func:`update`: ``edits(path, <some editable columns>)``; nulls leave a value as it is.

    Edits of one path are one: of each column the greatest value that is given.
    """
    fields = [c for c in edits.columns if c != "path"]
    checked_fields(dict.fromkeys(fields))
    types = {f.name: f.dataType for f in TAGS_SCHEMA.fields}
    edits = edits.where(F.col("path").isNotNull()).groupBy("path").agg(*(F.max(c).alias(c) for c in fields))
    new = edits.select("path", *(F.col(c).cast(types[c]).alias(f"__{c}") for c in fields), F.lit(True).alias("__hit"))
    joined = tags.join(new, "path", "full")
    none = {"instruments": F.array().cast("array<string>"), "genres": F.array().cast(GENRES_DDL), "filename": F.element_at(F.split("path", "/"), -1), "edited": F.lit(False)}
    stamp = {"edited": F.coalesce("__hit", "edited"), "scanned_at": F.when(F.col("__hit"), F.lit(float(now))).otherwise(F.col("scanned_at"))}
    plain = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in fields else F.col(c)
    missing = F.col("scanned_at").isNull() & F.col("mtime").isNull() & F.col("edited").isNull()
    return joined.select(*[stamp[c].alias(c) if c in stamp else (F.coalesce(plain(c), F.when(missing, none[c])) if c in none else plain(c)).alias(c) for c in tags.columns])


def delete(tags: DataFrame, paths: DataFrame) -> DataFrame:
    return tags.join(paths.select("path"), "path", "left_anti")


# --- collections ---------------------------------------------------------------------------------


def member_paths(collections: DataFrame, members: DataFrame, name: str) -> DataFrame:
    return members.join(collections.where(F.col("name") == name).select(F.col("id").alias("collection_id")), "collection_id").select("path")


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Every collection with its number of paths (dangling ones too), by name; empty ones count 0."""
    counted = members.where(F.col("path").isNotNull()).groupBy("collection_id").agg(F.count("*").alias("count"))  # summed before the join
    joined = collections.join(counted, collections["id"] == counted["collection_id"], "left")
    return joined.select("id", "name", "created_at", F.coalesce("count", F.lit(0)).alias("count")).orderBy("name")


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Union with the (collection_id, path) pairs that are not there yet."""
    keys = ["collection_id", "path"]
    return members.unionByName(new.dropDuplicates(keys).join(members.select(keys), keys, "left_anti").select(members.columns))


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    keys = ["collection_id", "path"]
    return members.join(gone.select(keys), keys, "left_anti")


def delete_collection(collections: DataFrame, members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the collection and its memberships."""
    gone = collections.where(F.col("name") == name).select(F.col("id").alias("collection_id"))
    return collections.where(F.col("name") != name), members.join(gone, "collection_id", "left_anti").select(members.columns)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))
