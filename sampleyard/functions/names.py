"""The name pass: kind, category, tempo, key and instruments from the parts of a path.

All functions take and return Columns.  The long rule chains are evaluated once per path part
inside ``transform``, so a deep path does not unroll them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as T

#: As the engine's patterns spell them: case left out of account for tempos, Unicode word ends for keys.
EXPLICIT_BPM, KEY, KEY_SHARP_S = f"(?i){T.EXPLICIT_BPM}", f"(?U){T.KEY}", f"(?U){T.KEY_SHARP_S}"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def fragments(path: Column) -> Column:
    """Folders from the root on, then the stem; empty parts dropped."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.filter(F.concat(folders, F.array(stem(F.element_at(parts, -1)))), lambda x: x != "")


def parse_kind(text: Column, low: Column | None = None) -> Column:
    """``low``: the text in lower case, where it is at hand."""
    low = F.lower(text) if low is None else low
    return F.when(low.contains("loop"), "loop").when(low.rlike(T.ONE_SHOT), "one-shot").when(low.rlike(T.RECORDING), "recording")


def parse_category(text: Column, low: Column | None = None) -> Column:
    """The fine label of the first rule with a keyword anywhere in the text."""
    low = F.lower(text) if low is None else low
    chain = None
    for label, keywords in T.CATEGORY_RULES:
        hit = reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def parse_bpm(text: Column) -> Column:
    """An explicit tempo of 40..220, else a bare number of 60..200; of each pattern the first match counts."""
    group = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    named = F.coalesce(group(EXPLICIT_BPM, 1), group(EXPLICIT_BPM, 2)).cast("double")
    bare = group(T.BARE_NUMBER, 1).cast("double")
    return F.when(named.between(40, 220), named).when(bare.between(60, 200), bare)


def parse_key(text: Column) -> Column:
    """STRUCT<key, scale, confidence>; null where the text names no key."""

    def scale(raw: Column) -> Column:
        low = F.lower(raw)
        return F.when(low.startswith("maj"), "major").when(low.startswith("m"), "minor")

    plain, sharp = F.regexp_extract(text, KEY, 1), F.regexp_extract(text, KEY_SHARP_S, 1)
    plain_scale, sharp_scale = scale(F.regexp_extract(text, KEY, 2)), scale(F.regexp_extract(text, KEY_SHARP_S, 2))
    flats, sharps = literal_map(T.FLATS), literal_map(T.NAMED_SHARPS)
    confidence = lambda s: F.when(s.isNotNull(), T.KEY_SCALE_CONFIDENCE).otherwise(T.KEY_ONLY_CONFIDENCE)
    named = F.concat(sharp, F.lit("#"))
    return F.when(plain != "", F.struct(F.coalesce(flats[plain], plain).alias("key"), plain_scale.alias("scale"), confidence(plain_scale).alias("confidence"))).when(
        sharp != "", F.struct(F.coalesce(sharps[named], named).alias("key"), sharp_scale.alias("scale"), confidence(sharp_scale).alias("confidence"))
    )


def nearest(values: Column) -> Column:
    """First non-null of an array, null if there is none."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def coarse(label: Column) -> Column:
    return F.when(label.isin(T.MELODIC), "melodic").otherwise(label)


def cue_text(frs: Column) -> Column:
    """The fragments as one lower-case text, joints made spaces: where a vocal's cues are looked for."""
    return F.regexp_replace(F.lower(F.array_join(frs, " ")), r"[_\-.]+", " ")


def instruments_of(label: Column, low: Column) -> Column:
    """Instrument tags of a fine label; a vocal's subtype comes from cues anywhere in the path's :func:`cue_text`."""
    said = lambda cues: reduce(lambda a, b: a | b, [low.contains(c) for c in cues])
    return (
        F.when(label.isin("drums", "perc"), strings(["drums"]))
        .when(label.isin(T.DRUM_NAMES), F.array_sort(F.array(label, F.lit("drums"))))
        .when(label.isin(T.SELF_NAMES), F.array(label))
        .when(label.isin(T.FX_NAMES), strings(["fx"]))
        .when((label == "vocal") & said(T.SPOKEN_CUES), strings(["spoken"]))
        .when((label == "vocal") & said(T.SINGING_CUES), strings(["singing"]))
        .when(label == "vocal", strings(["vocal"]))
        .otherwise(strings([]))
    )


def name_parts(frs: Column) -> Column:
    """STRUCT of what the fragments say, nearest to the file first: kind, label, tempo, keys, and the fragments."""
    near = F.reverse(frs)
    return F.struct(
        frs.alias("fragments"),
        nearest(F.transform(near, lambda x: parse_kind(x))).alias("kind"),
        nearest(F.transform(near, lambda x: parse_category(x))).alias("label"),
        nearest(F.transform(near, parse_bpm)).alias("bpm"),
        F.transform(near, parse_key).alias("keys"),
    )


def from_parts(parts: Column) -> Column:
    """The verdict STRUCT of :func:`name_parts`: kind, category, key, scale, bpm, instruments, confidence, source."""
    keys = parts["keys"]
    certain = F.get(F.filter(keys, lambda k: k["confidence"] == T.KEY_SCALE_CONFIDENCE), F.lit(0))
    return let(F.coalesce(certain, nearest(keys)), lambda key: _verdict(parts, key))


def _verdict(parts: Column, key: Column) -> Column:
    return verdict(parts["kind"], parts["label"], parts["bpm"], key, cue_text(parts["fragments"]))


def verdict(kind: Column, label: Column, bpm: Column, key: Column, low: Column) -> Column:
    """The name pass' STRUCT from what was found, and the path's :func:`cue_text`."""
    flags = F.concat(
        *[found.isNotNull().cast("int").cast("string") for found in (kind, label, bpm)],
        F.when(key.isNull(), "0.0").when(key["confidence"] == T.KEY_SCALE_CONFIDENCE, "0.9").otherwise("0.6"),
    )
    return F.struct(
        kind.alias("kind"),
        coarse(label).alias("category"),
        key["key"].alias("key"),
        key["scale"].alias("scale"),
        bpm.alias("bpm"),
        instruments_of(label, low).alias("instruments"),
        literal_map(T.name_confidences())[flags].alias("confidence"),
        F.lit("name").alias("source"),
    )


def classify_name(path: Column) -> Column:
    """The whole name pass over one path, each part computed once."""
    return let(let(fragments(path), name_parts), from_parts)


# --- file-name helpers of single clips ---------------------------------------------------------


def warp_from_filename(filename: Column) -> Column:
    low = F.lower(stem(file_name(filename)))
    chain = None
    for mode, cues in T.WARP_CUES.items():
        hit = reduce(lambda a, b: a | b, [low.contains(c) for c in cues])
        chain = F.when(hit, mode) if chain is None else chain.when(hit, mode)
    return chain


def bpm_from_filename(filename: Column) -> Column:
    """Explicit tempo of any size, else a bare number of 40..220."""
    low = F.lower(stem(file_name(filename)))
    group = lambda pattern, k: F.nullif(F.regexp_extract(low, pattern, k), F.lit("")).cast("double")
    bare = group(T.BARE_NUMBER_IN_FILENAME, 1)
    return F.coalesce(group(EXPLICIT_BPM, 1), group(EXPLICIT_BPM, 2), F.when(bare.between(40, 220), bare))


def kind_from_filename(filename: Column) -> Column:
    low = F.lower(stem(file_name(filename)))
    return F.when(low.contains("loop"), "loop").when(low.rlike(T.ONE_SHOT_IN_FILENAME), "one-shot")
