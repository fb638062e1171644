"""Captions through the word index: what the patterns of each term find."""

import itertools

from pyspark.sql import functions as F

from sampleyard.functions import captions
from sampleyard.functions import taxonomy as T
from sampleyard.operators import caption_index
from sampleyard.plans.projections import projected


def test_forms_are_words_at_both_ends():
    for first, pieces, *_ in caption_index.form_rows():
        assert first == pieces[0] and all(p.replace("_", "a").isalnum() for p in (pieces[0], pieces[-1])) and "".join(pieces) == "".join(pieces).lower()


def test_the_index_finds_what_the_patterns_find(spark):
    every = list(dict.fromkeys(f for t in [*T.INSTRUMENTS, *T.GENRES, *itertools.chain(*T.CATEGORIES.values())] for f in captions.forms(t)))
    said = [None, "", "   ", "...", "á kicḱ drum", "Kick, KICK; kick-drum kick_drum kicks", "hip hop hip-hop HIP  HOP hiphop", "d&b d & b drum and bass", "unébass bassé bass", "808 808s x808", "white noise and noise, static noise hiss", "sung vocal melody sung vocal", "noise white noise white noise"]
    said += [f"{a} {b}-{a}, {c}" for a, b, c in zip(every, every[7:] + every[:7], every[3:] + every[:3], strict=True)]
    rows = [(i, T.KINDS[i % 4] if i % 5 else None, c, "x", ["y"]) for i, c in enumerate(said)]
    df = spark.createDataFrame(rows, "file_id long, kind string, caption string, ranking string, instruments array<string>")
    df = df.unionByName(projected(spark, "/root/testdata/sf0.001", "lib_captions").limit(500).select((F.col("file_id") + 10**6).alias("file_id"), "kind", "caption", F.lit("x").alias("ranking"), F.array(F.lit("y")).alias("instruments")))
    got = {r["file_id"]: r["verdict"] for r in caption_index.with_verdicts(df).collect()}
    want = {r["file_id"]: r["v"] for r in df.select("file_id", captions.recognise_caption(F.col("caption"), F.col("kind")).alias("v")).collect()}
    assert len(got) == df.count() and got == want
    terms = {r["file_id"]: [(s["rank"], s["term"]) for s in r["ranking"]] for r in caption_index.with_terms(df.select("file_id", "kind", "caption")).collect()}
    ranked = {r["file_id"]: [(s["rank"], s["term"]) for s in r["v"] or []] for r in df.select("file_id", captions.rank_categories(F.col("caption"), F.col("kind")).alias("v")).collect()}
    assert terms == ranked


def test_captions_without_rows_or_keys(spark):
    none = spark.createDataFrame([(None, "loop", "a kick"), (1, "loop", None)], "file_id long, kind string, caption string")
    assert [r["verdict"]["category"] if r["verdict"] else None for r in caption_index.with_verdicts(none).orderBy(F.col("file_id").asc_nulls_first()).collect()] == ["fx", None]
    assert caption_index.with_verdicts(none.limit(0)).count() == 0
