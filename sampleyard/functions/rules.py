"""Decision lists: kind, one-shot and warp rules on features, instruments of a verdict, escalation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy as T
from .names import literal_map, parse_category, nearest, fragments, strings


def resolve_kind(name_kind: Column, category: Column, bpm: Column, duration: Column) -> Column:
    """A name cue, else length, else whole bars at the tempo, else a drum name, else unknown."""
    bars = duration / (F.lit(240.0) / bpm)
    counts = F.array_sort(F.array(*[F.struct(F.abs(F.lit(float(n)) - bars).alias("off"), F.lit(n).alias("n")) for n in T.BAR_COUNTS]))
    near = F.get(counts, F.lit(0))
    return (
        F.when(name_kind.isNotNull(), name_kind)
        .when(duration <= T.ONESHOT_SECONDS, "one-shot")
        .when(duration >= T.RECORDING_SECONDS, "recording")
        .when((bpm != 0) & duration.isNotNull() & (near["off"] <= T.BAR_TOLERANCE * near["n"]), "loop")
        .when(category.isin(T.KIND_DRUMS), "one-shot")
        .otherwise("unknown")
    )


def classify_oneshot(f: Column) -> Column:
    """Category of a one-shot from its feature STRUCT; the first rule that holds decides."""
    centroid, rolloff, zcr = f["spectral_centroid"], f["spectral_rolloff"], f["zero_crossing_rate"]
    voiced, stability = f["voiced_ratio"], f["pitch_stability"]
    fast, percussive = f["log_attack_time"] <= T.FAST_ATTACK, f["percussive_ratio"] >= T.PERCUSSIVE
    noisy = zcr >= T.NOISY
    return (
        F.when((centroid >= T.HAT_CENTROID) & (rolloff >= T.HAT_ROLLOFF) & noisy, "hat")
        .when((zcr < T.LOW_CROSSINGS) & (centroid <= T.LOW_CENTROID), F.when(fast | percussive, "kick").otherwise("bass"))
        .when(percussive & noisy & fast, F.when(centroid >= T.CLAP_CENTROID, "clap").otherwise("snare"))
        .when((voiced > T.VOICED) & centroid.between(*T.VOCAL_CENTROID) & (stability >= T.VOCAL_STABILITY) & ~percussive, "vocal")
        .when((voiced > T.VOICED) & (stability < T.STEADY), "melodic")
        .when(centroid <= T.BASS_CENTROID, "bass")
        .when(percussive, "perc")
        .otherwise("fx")
    )


def warp_mode(f: Column) -> Column:
    voiced, stability = f["voiced_ratio"], f["pitch_stability"]
    return (
        F.when((f["transient_density"] > T.WARP_DENSITY) & (f["percussive_ratio"] > T.WARP_PERCUSSIVE), "beats")
        .when((voiced > T.WARP_VOCAL) & (f["formant_strength"] > T.WARP_FORMANT), "vocal")
        .when((voiced > T.WARP_MELODIC) & (stability < T.STEADY), "melodic")
        .when((voiced > T.WARP_HARMONIC) & (stability >= T.STEADY), "harmonic")
        .otherwise("complex")
    )


def classify_loop(f: Column) -> Column:
    return F.coalesce(literal_map(T.WARP_CATEGORY)[warp_mode(f)], F.lit("full"))


def heuristic_instruments(category: Column) -> Column:
    return (
        F.when(category.isin("perc", "drum"), strings(["drums"]))
        .when(category.isin(T.HEURISTIC_DRUMS), F.array_sort(F.array(category, F.lit("drums"))))
        .when(category.isin(T.HEURISTIC_SELF), F.array(category))
        .otherwise(strings([]))
    )


def recognise_features(f: Column, kind: Column) -> Column:
    """The heuristic verdict STRUCT; null where there are no features."""
    category = F.when(kind.isin("loop", "recording"), classify_loop(f)).otherwise(classify_oneshot(f))
    return F.when(
        f.isNotNull(),
        F.struct(
            category.alias("category"),
            heuristic_instruments(category).alias("instruments"),
            F.lit("heuristic").alias("source"),
            F.lit(T.HEURISTIC_CONFIDENCE).alias("confidence"),
            F.lit(None).cast("string").alias("caption"),
            F.array().cast("array<struct<genre:string,score:double,source:string>>").alias("genres"),
        ),
    )


def needs_escalation(instruments: Column, category: Column, path: Column, filename: Column) -> Column:
    """Whether a verdict is not to be trusted: no instruments, and no category, a catch-all one, or a pitched one the name does not confirm."""
    named = nearest(F.transform(F.reverse(fragments(F.coalesce(F.nullif(path, F.lit("")), filename, F.lit("")))), lambda x: parse_category(x)))
    doubtful = category.isNull() | (category == "") | category.isin(T.CATCHALL) | (category.isin(T.GUESSED) & named.isNull())
    return (F.coalesce(F.size(instruments), F.lit(0)) <= 0) & F.coalesce(doubtful, F.lit(True))


def loop_context_candidate(kind: Column, duration: Column, category: Column, voiced_ratio: Column) -> Column:
    """Short unpitched one-shots with a tonal verdict: worth hearing again as a loop."""
    return (kind == "one-shot") & F.coalesce(duration <= T.LOOP_CONTEXT["seconds"], F.lit(False)) & category.isin(T.LOOP_CONTEXT_TONAL) & (voiced_ratio < T.LOOP_CONTEXT["voiced"])


def loop_context_override(verdict: Column, again: Column) -> Column:
    """The second verdict (of the sound as a loop, read with one-shot categories) where it names a drum, without genres; else the first."""
    genres = F.array().cast("array<struct<genre:string,score:double,source:string>>")
    return F.when(again["category"].isin(T.LOOP_CONTEXT_DRUMS), again.withField("genres", genres)).otherwise(verdict)
