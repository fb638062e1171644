"""The name pass on named cases, and its quirks."""

import pytest
from pyspark.sql import functions as F

from sampleyard.functions import names
from sampleyard.functions import taxonomy as T

# path, kind, category, key, scale, bpm; "." is not asserted
CASES = [
    ("/Samples/House Loops/Cm 124bpm/bassline.wav", "loop", "bass", "C", "minor", 124.0),
    ("/Packs/Oneshots/kick_punch.wav", "one-shot", "kick", ".", ".", "."),
    ("/Samples/Drum Loops/140bpm/clap loop.wav", "loop", "clap", ".", ".", 140.0),
    ("/Library/Synth Leads/Am/synth_lead_stab.wav", "one-shot", "melodic", "A", "minor", "."),
    ("/Library/Pads/G_maj_pad_80bpm.wav", ".", "melodic", "G", "major", 80.0),
    ("/Library/fx_riser_oneshot_Fm.wav", "one-shot", "riser", "F", "minor", "."),
    ("/Samples/loop_128bpm.wav", ".", ".", ".", ".", 128.0),
    ("/Samples/bpm128_loop.wav", ".", ".", ".", ".", 128.0),
    ("/Samples/loop_90_beats.wav", ".", ".", ".", ".", 90.0),
    ("/Samples/120 BPM/lead.wav", ".", ".", ".", ".", 120.0),
    ("/Packs/F#m Loops/bass_loop.wav", "loop", "bass", "F#", "minor", "."),
    ("/Packs/Db major/synth_chord.wav", ".", "melodic", "C#", "major", "."),
    ("/Packs/Hip Hop/87_Ds_GoodlifeSoulString_SP.wav", ".", ".", "D#", None, 87.0),
    ("/Packs/120_Asmin_thing.wav", ".", ".", "A#", "minor", 120.0),
    ("/Packs/Bass_loop.wav", ".", "bass", None, None, "."),
    # substring keywords, rule order, only the first bare number, and the word boundary after m
    ("/x/custom_that.wav", None, "hat", None, None, None),
    ("/x/808_120.wav", None, "808", None, None, None),
    ("/x/Cm_pad.wav", None, "melodic", None, None, None),
    ("/x/Cmin_pad.wav", None, "melodic", "C", "minor", None),
    ("/x/Cm7 thing.wav", None, None, None, None, None),
    ("/x/Es_tone.wav", None, None, "F", None, None),
    ("/x/E# tone.wav", None, None, "E#", None, None),
    ("/x/riser_fx.wav", None, "riser", None, None, None),
    ("/x/voice-memo 3.wav", "recording", "vocal", None, None, None),
    ("/white.wav", None, None, None, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "path string").select("path", names.classify_name(F.col("path")).alias("n"))
    got = {r["path"]: r["n"] for r in df.collect()}
    for path, *wanted in CASES:
        n = got[path]
        for field, value in zip(("kind", "category", "key", "scale", "bpm"), wanted, strict=True):
            assert value == "." or n[field] == value, (path, field, n)


def test_worked_example_rounds_half_even(spark):
    df = spark.createDataFrame([("/Samples/House Loops/Cm 124bpm/bassline.wav",), ("/Library/Pack1/track01.wav",)], "path string")
    assert [r[0] for r in df.select(names.classify_name(F.col("path"))["confidence"]).collect()] == [0.887, 0.0]
    assert T.name_confidences()["1110.6"] == 0.812


@pytest.mark.parametrize(
    ("name", "tags"),
    [("vox_talking", ["spoken"]), ("acapella_hook", ["singing"]), ("vocal_hit", ["vocal"]), ("snare", ["drums", "snare"]), ("clap", ["clap", "drums"]), ("perc", ["drums"]), ("foley", ["fx"]), ("melody", []), ("piano", ["piano"])],
)
def test_instruments(spark, name, tags):
    df = spark.createDataFrame([(f"/a/{name}.wav",)], "path string")
    assert df.select(names.classify_name(F.col("path"))["instruments"]).first()[0] == tags


def test_empty_and_odd_paths(spark):
    df = spark.createDataFrame([("",), ("kick",), ("/",), (None,)], "path string").select("path", names.classify_name(F.col("path")).alias("n"))
    got = {r["path"]: r["n"] for r in df.collect()}
    assert got["kick"]["category"] == "kick" and got[""]["category"] is None and got["/"]["confidence"] == 0.0
    assert got[None] is None or got[None]["category"] is None


def test_vocabulary_sizes():
    assert [len(T.CATEGORIES[k]) for k in ("one-shot", "loop", "recording")] == [25, 13, 9]
    assert len(T.INSTRUMENTS) == 68 and len(T.GENRES) == 42 and set(T.INSTRUMENT_CATEGORIES) == set(T.INSTRUMENTS)


def test_paths_by_their_parts_are_as_one_by_one(spark):
    """Folders parsed once give what the row-local pass gives, for nulls, roots, bare names and columns of clashing names too."""
    from sampleyard.operators import path_names
    from sampleyard.plans.projections import projected

    odd = [None, "", "/", "kick.wav", "/kick.wav", "//a//124bpm//Cm/lead.wav", "/F#m Loops/Ds pad/", "loops/x", "/one shots/90bpm/Am/40bpm_C.wav", "/vocals/talk/vox_Cmin.wav", "/Loop/take2", "/.hidden", "/a.b/c.d.wav"]
    files = spark.createDataFrame([(p, "k", 1.0, "f", "low") for p in odd + odd], "path string, kind string, bpm double, folder string, name string")
    files = files.unionByName(projected(spark, "/root/testdata/sf0.001", "lib_files").limit(400).select("path", F.lit("k").alias("kind"), F.lit(1.0).alias("bpm"), F.lit("f").alias("folder"), F.lit("low").alias("name")))
    got = path_names.with_names(files, name="said").collect()
    want = files.withColumn("said", names.classify_name(F.col("path"))).collect()
    key = lambda r: (r["path"] is not None, r["path"] or "")
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == len(odd) * 2 + 400
    assert path_names.with_names(files.limit(0)).count() == 0


def test_a_folder_is_parsed_once(spark):
    """The parts that are parsed are the distinct folders' distinct ones, however many files they hold."""
    from sampleyard.operators import path_names

    files = spark.range(5000).select(F.concat(F.lit("/Packs/House Loops/"), F.col("id").cast("string"), F.lit(".wav")).alias("path"))
    folders = files.select(F.regexp_replace("path", "[^/]*$", "").alias("folder")).distinct()
    assert [(r["folder"], r["folder_kind"], r["folder_label"]) for r in path_names.folder_cues(folders).collect()] == [("/Packs/House Loops/", "loop", None)]


#: Cases of the name pass with their expected kind, category, key, scale and tempo.
GOLDEN = [
    ("/Samples/House Loops/Cm 124bpm/bassline.wav", "loop", "bass", "C", "minor", 124.0),
    ("/Samples/One Shots/kick_01.wav", "one-shot", "kick", None, None, None),
    ("/x/808_120.wav", None, "808", None, None, None),
    ("/x/Cm_pad.wav", None, "melodic", None, None, None),
    ("/x/Cmin_pad.wav", None, "melodic", "C", "minor", None),
    ("/x/Cmaj7 chord.wav", None, "melodic", "C", "major", None),
    ("/x/128_Ds_lead.wav", None, "melodic", "D#", None, 128.0),
    ("/x/Es 90.wav", None, None, "F", None, 90.0),
    ("/x/E# 90.wav", None, None, "E#", None, 90.0),
    ("/x/Bb min vox.wav", None, "vocal", "A#", "minor", None),
    ("/x/voice-memo 12.wav", "recording", "vocal", None, None, None),
    ("/x/full_mix_take2.wav", "recording", None, None, None, None),
    ("/x/bpm 230 drumloop 100.wav", "loop", "drums", None, None, None),
    ("/90/x 40bpm.wav", None, None, None, None, 40.0),
]


@pytest.mark.parametrize("path, kind, category, key, scale, bpm", GOLDEN)
def test_golden_names(spark, path, kind, category, key, scale, bpm):
    r = spark.range(1).select(names.classify_name(F.lit(path)).alias("n")).select("n.*").first()
    assert (r["kind"], r["category"], r["key"], r["scale"], r["bpm"]) == (kind, category, key, scale, bpm)
