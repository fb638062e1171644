"""Captions, similarities, rules, merging and fusing on named cases."""

import pytest
from pyspark.sql import functions as F

from sampleyard.functions import captions, fusion, names, rules, similarity
from sampleyard.functions import taxonomy as T

GENRES = fusion.GENRE_TYPE
FEATURE = {"spectral_centroid": 1000.0, "spectral_rolloff": 2000.0, "zero_crossing_rate": 0.05, "log_attack_time": -1.0, "percussive_ratio": 0.3, "voiced_ratio": 0.0, "pitch_stability": 1.0, "formant_strength": 0.0, "transient_density": 0.0}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_caption_ranking(spark):
    said = lambda text, kind: one(spark, captions.recognise_caption(F.lit(text), F.lit(kind)))
    assert said("A bass groove, heavy bass with percussive noise", "loop")["category"] == "bass"
    assert said("a struck cowbell", "one-shot")["category"] == "perc"
    assert said("a struck cowbell", "one-shot")["confidence"] == 0.5
    assert said("nothing in particular", "loop")["category"] == "fx"
    assert said("a string stab on a synthesizer", "loop")["instruments"] == ["stab", "synth", "strings"]
    assert said("subtle and snappy primary", "one-shot")["instruments"] == []
    assert said("", "loop") is None and one(spark, captions.recognise_caption(F.lit(None).cast("string"), F.lit("loop"))) is None


def test_caption_genres(spark):
    got = one(spark, captions.score_genres(F.lit("techno, techno and a bit of hip-hop; d&b")))
    assert [(g["genre"], g["score"]) for g in got] == [("techno", 0.3), ("drum and bass", 0.15), ("hip hop", 0.15)]


def test_similarity_picks(spark):
    sims = lambda hot: F.array(*[F.lit(float(hot.get(g, 0.1))) for g in T.GENRES])
    got = one(spark, similarity.rank_genres(sims({"house": 0.6, "techno": 0.45})))
    assert [g["genre"] for g in got] == ["house"] and got[0]["score"] > 0.9
    assert one(spark, similarity.rank_genres(sims({g: 0.25 for g in T.GENRES}))) == []
    assert one(spark, similarity.rank_genres(sims({"house": 0.2}))) == []
    top = similarity.top_labels(F.array(*[F.lit(x) for x in (0.1, 0.9, 0.5, 0.44, 0.46, 0.9, 0.6)]), list("abcdefg"))
    assert one(spark, top) == ["b", "f", "g", "c"]
    negative = similarity.top_labels(F.array(F.lit(-0.4), F.lit(-0.1), F.lit(-0.2)), list("abc"))
    assert one(spark, negative) == ["b"]


@pytest.mark.parametrize(
    ("change", "category"),
    [
        ({"spectral_centroid": 6000.0, "spectral_rolloff": 9000.0, "zero_crossing_rate": 0.3}, "hat"),
        ({"zero_crossing_rate": 0.01, "log_attack_time": -2.0}, "kick"),
        ({"zero_crossing_rate": 0.01}, "bass"),
        ({"percussive_ratio": 0.8, "zero_crossing_rate": 0.2, "log_attack_time": -2.0, "spectral_centroid": 2500.0}, "clap"),
        ({"percussive_ratio": 0.8, "zero_crossing_rate": 0.2, "log_attack_time": -2.0}, "snare"),
        ({"voiced_ratio": 0.8, "pitch_stability": 0.2}, "vocal"),
        ({"voiced_ratio": 0.8, "pitch_stability": 0.01}, "melodic"),
        ({"spectral_centroid": 300.0}, "bass"),
        ({"percussive_ratio": 0.8}, "perc"),
        ({}, "fx"),
    ],
)
def test_oneshot_rules(spark, change, category):
    f = F.struct(*[F.lit(v).alias(k) for k, v in (FEATURE | change).items()])
    assert one(spark, rules.classify_oneshot(f)) == category


@pytest.mark.parametrize(
    ("args", "kind"),
    [
        (("loop", None, None, 0.1), "loop"), ((None, None, None, 1.2), "one-shot"), ((None, None, None, 30.0), "recording"), ((None, None, 120.0, 4.1), "loop"),
        ((None, None, 120.0, 5.0), "unknown"), ((None, "kick", None, 5.0), "one-shot"), ((None, "snap", None, None), "unknown"), ((None, None, 120.0, 3.0), "unknown"),
    ],
)
def test_kind(spark, args, kind):
    n, c, b, s = args
    assert one(spark, rules.resolve_kind(F.lit(n).cast("string"), F.lit(c).cast("string"), F.lit(b).cast("double"), F.lit(s).cast("double"))) == kind


@pytest.mark.parametrize(
    ("category", "instruments", "path", "wanted"),
    [
        (None, [], "a.wav", True), ("fx", [], "a.wav", True), ("full", [], "a.wav", True), ("bass", [], "Combo-70s.wav", True), ("vocal", [], "spanish triumphant1.wav", True),
        ("bass", [], "deep_bass_hit.wav", False), ("melodic", [], "grand_piano.wav", False), ("kick", [], "anon.wav", False), ("bass", ["bass"], "Combo.wav", False), ("fx", ["fx"], "Combo.wav", False),
    ],
)
def test_escalation(spark, category, instruments, path, wanted):
    got = rules.needs_escalation(names.strings(instruments), F.lit(category).cast("string"), F.lit(path), F.lit(None).cast("string"))
    assert one(spark, got) is wanted


def verdict(category, source, confidence, instruments=(), genres=(), caption=None):
    g = [(n, s, source) for n, s in genres]
    return (category, list(instruments), source, confidence, caption, g)


def merged(spark, verdicts):
    schema = f"v array<struct<category:string,instruments:array<string>,source:string,confidence:double,caption:string,genres:{GENRES}>>"
    return spark.createDataFrame([(verdicts,)], schema).select(fusion.merge(F.col("v")).alias("m")).first()["m"]


def test_merge(spark):
    a, b, c = verdict("kick", "clap", 0.9, ["kick"], [("house", 0.4)]), verdict("bass", "ace-step", 0.7, ["bass", "kick"], [("house", 0.5), ("techno", 0.5)], "a bass"), verdict("bass", "heuristic", 0.55)
    m = merged(spark, [a, b, c])
    assert (m["category"], m["confidence"], m["source"], m["caption"], m["instruments"]) == ("bass", 0.9, "ace-step+clap+heuristic", "a bass", ["kick", "bass"])
    assert [(g["genre"], g["score"], g["source"]) for g in m["genres"]] == [("house", 0.5, "ace-step"), ("techno", 0.5, "ace-step")]
    assert merged(spark, [verdict("kick", "clap", 0.7), verdict("bass", "ace-step", 0.7)])["category"] == "bass"  # precedence
    assert merged(spark, [verdict("kick", "clap", 0.8), verdict("bass", "ace-step", 0.7)])["category"] == "kick"
    assert merged(spark, [None, None]) is None
    alone = merged(spark, [None, verdict("kick", "clap", 0.7, ["a", "a"])])
    assert alone["source"] == "clap" and alone["instruments"] == ["a", "a"]


def test_loop_context(spark):
    first = F.struct(F.lit("melodic").alias("category"), F.lit("x").alias("genres"))
    again = lambda c: F.struct(F.lit(c).alias("category"), F.array().cast(GENRES).alias("genres"))
    assert one(spark, rules.loop_context_candidate(F.lit("one-shot"), F.lit(1.0), F.lit("bass"), F.lit(0.1)))
    assert not one(spark, rules.loop_context_candidate(F.lit("one-shot"), F.lit(None).cast("double"), F.lit("bass"), F.lit(0.1)))
    assert one(spark, rules.loop_context_override(again("melodic"), again("kick")))["category"] == "kick"
    assert one(spark, rules.loop_context_override(again("melodic"), again("fx")))["category"] == "melodic"
    assert first is not None
