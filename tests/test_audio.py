"""Audio files, features, recognisers and streams."""

import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sampleyard.functions import rules, signal
from sampleyard.operators import recognisers, scan
from sampleyard.plans import audio_queries
from sampleyard.sources import audio
from sampleyard.sources.catalog import Catalog
from sampleyard.sources.errors import BackendError, BadInputError
from sampleyard.streaming import ingest

RATE = 22_050


def tone(hertz, seconds, decay=0.0):
    t = np.arange(int(RATE * seconds)) / RATE
    return np.sin(2 * np.pi * hertz * t) * np.exp(-decay * t)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "lib").mkdir()
    sounds = {"lib/kick_01.wav": tone(60, 0.3, 20), "lib/b.WAV": tone(440, 0.8), "a.wav": np.zeros(RATE * 2), "lib/._skip.wav": tone(1, 0.1)}
    for name, y in sounds.items():
        (tmp_path / name).write_bytes(audio.encode_wav(0.8 * y, RATE))
    (tmp_path / "broken.wav").write_bytes(b"not audio")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_listing(spark, folder):
    listed = audio.list_files(spark, str(folder))
    assert [r["path"].rsplit("/", 1)[-1] for r in listed.collect()] == ["a.wav", "broken.wav", "b.WAV", "kick_01.wav"]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_durations_and_features(spark, folder):
    files = audio.read_files(spark, str(folder))
    seconds = {r["path"].rsplit("/", 1)[-1]: r["duration"] for r in audio.with_durations(files).collect()}
    assert seconds["a.wav"] == 2.0 and seconds["broken.wav"] is None and abs(seconds["kick_01.wav"] - 0.3) < 1e-3
    got = {r["path"].rsplit("/", 1)[-1]: r["features"] for r in audio.with_features(files).collect()}
    assert got["broken.wav"] is None and got["a.wav"]["percussive_ratio"] == 0.0
    assert abs(got["b.WAV"]["spectral_centroid"] - 440) < 60 and got["b.WAV"]["voiced_ratio"] > 0.9 and got["b.WAV"]["pitch_stability"] < 0.01
    assert int(np.argmax(got["b.WAV"]["chroma"])) == 9


def test_headers():
    assert audio.duration(b"") is None and audio.duration(b"RIFF") is None
    flac = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + ((44_100 << 44) | 88_200).to_bytes(8, "big") + bytes(16)
    assert audio.duration(flac) == 2.0
    y, rate = audio.decode(audio.encode_wav(np.array([0.0, 0.5, -0.5]), 8000))
    assert rate == 8000 and np.allclose(y, [0, 0.5, -0.5], atol=1e-3)


def test_headers_beyond_the_leading_bytes(spark):
    def chunk(tag, body, order="<"):
        return tag + struct.pack(f"{order}I", len(body)) + body

    wave = audio.encode_wav(tone(440, 0.5), RATE)
    late = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + chunk(b"JUNK", bytes(100_000)) + wave[12:]
    sound = chunk(b"SSND", bytes(8 + 2 * 8000 * 6), ">")
    rate = struct.pack(">HQ", 16383 + 12, 8000 << 51)  # 8000 as an 80-bit float
    common = chunk(b"COMM", struct.pack(">hIh", 1, 8000 * 6, 16) + rate, ">")
    aiff = b"FORM" + struct.pack(">I", 0) + b"AIFF" + sound + common
    rows = [("late", late), ("aiff", aiff), ("early", wave), ("long", bytes(200_000)), ("null", None)]
    got = dict(audio.with_durations(spark.createDataFrame(rows, "path string, content binary")).collect())
    assert got == {"late": 0.5, "aiff": 6.0, "early": 0.5, "long": None, "null": None}


def page(position, body):
    return b"OggS" + bytes(2) + struct.pack("<q", position) + bytes(12) + bytes([1, len(body)]) + body


def mpeg(kbit_step=9, rate_step=0, frames=20, first=b""):
    """Version 1, layer 3 frames; 128 kbit/s at 44,100 Hz by default."""
    size = 144 * [32, 40, 48, 56, 64, 80, 96, 112, 128, 160][kbit_step - 1] * 1000 // 44_100
    head = bytes([0xFF, 0xFB, kbit_step << 4 | rate_step << 2, 0])
    return b"".join(head + (first if k == 0 else b"").ljust(size - 4, b"\0") for k in range(frames))


def test_headers_are_read_by_seeking(spark, tmp_path):
    """Durations of every listed format, from a bounded part of each file however long it is."""
    vorbis = b"\x01vorbis" + bytes(4) + b"\x02" + struct.pack("<I", 48_000) + bytes(14)
    opus = b"OpusHead" + bytes([1, 2]) + struct.pack("<HI", 480, 44_100) + bytes(3)
    tag = b"ID3\x04\x00\x00" + bytes([0, 4, 0, 0])  # 65,536 bytes of tag, as four groups of seven bits
    xing = bytes(32) + b"Info" + struct.pack(">II", 1, 1000)
    wave = audio.encode_wav(tone(440, 0.5), RATE)
    late = wave[:12] + b"JUNK" + struct.pack("<I", 3_000_000) + bytes(3_000_000) + wave[12:]
    flac = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + ((44_100 << 44) | 88_200).to_bytes(8, "big") + bytes(16)
    made = {
        "a.wav": (wave, 0.5), "late.wav": (late, 0.5), "b.flac": (flac + bytes(2_000_000), 2.0), "c.ogg": (page(0, vorbis) + bytes(2_000_000) + page(96_000, b"x"), 2.0),
        "d.ogg": (page(0, opus) + bytes(500) + page(48_480, b"x"), 1.0), "e.mp3": (mpeg(frames=4000), 4000 * 417 * 8 / 128_000), "f.mp3": (tag + bytes(65_536) + mpeg(first=xing), 1000 * 1152 / 44_100),
        "g.mp3": (b"ID3 but nothing more", None), "h.ogg": (b"OggS", None), "i.wav": (b"R", None), "j.mp3": (bytes(3_000_000), None),
    }
    for name, (raw, _) in made.items():
        (tmp_path / name).write_bytes(raw)
    files = audio.list_files(spark, f"file://{tmp_path}").unionByName(spark.createDataFrame([("/none/at/all.wav", 0.0, 0), (None, 0.0, 0)], "path string, mtime double, length long"))
    got = {(r["path"] or "").rsplit("/", 1)[-1]: (r["duration"], r["bytes_read"]) for r in audio.probed(files).collect()}
    assert {n: s for n, (s, _) in got.items()} == {n: pytest.approx(s, rel=1e-3) if s else None for n, (_, s) in made.items()} | {"all.wav": None, "": None}
    assert max(n for _, n in got.values()) <= (1 << 16) + 256 and got["late.wav"][1] < 100 and got["b.flac"][1] < 100
    assert {n: audio.duration(raw) for n, (raw, _) in made.items()} == {n: got[n][0] for n in made}


def test_features_of_known_signals(spark):
    clicks = np.zeros(RATE * 4)
    clicks[:: RATE // 2] = 1.0  # 120 beats a minute
    late = np.concatenate([np.zeros(RATE // 10), [1.0], np.zeros(RATE // 10)])
    noise = np.random.default_rng(0).standard_normal(RATE)
    made = {"steady": tone(441, 2.0), "struck": clicks, "late": late, "noise": noise, "none": np.zeros(0), "silent": np.zeros(RATE)}
    signals = spark.createDataFrame([(name, float(RATE), y.tolist()) for name, y in made.items()] + [("unread", None, None)], "clip string, rate double, y array<double>")
    got = {r["clip"]: r["features"] for r in audio.signal_features(signals).collect()}
    steady, struck = got["steady"], got["struck"]
    assert set(got) == set(made)
    assert abs(steady["spectral_centroid"] - 441) < 30 and abs(steady["spectral_rolloff"] - 441) < 30
    assert abs(steady["zero_crossing_rate"] - 2 * 441 / RATE) < 1e-3
    assert steady["percussive_ratio"] < 0.2 < 0.8 < struck["percussive_ratio"]
    assert abs(struck["tempo"] - 120) < 5 and abs(struck["transient_density"] - 2) < 0.6
    assert abs(got["late"]["log_attack_time"] + 1) < 1e-3
    assert steady["voiced_ratio"] > 0.9 and got["noise"]["voiced_ratio"] < 0.2
    assert got["none"]["log_attack_time"] == -3.0 and got["none"]["pitch_stability"] == 1.0 and got["none"]["chroma"] == [0.0] * 12
    assert got["silent"]["tempo"] == got["silent"]["transient_density"] == got["silent"]["spectral_rolloff"] == 0.0
    # of a known spectrum, by hand
    y = np.array(made["struck"][:6000])
    cut = np.lib.stride_tricks.sliding_window_view(y, audio.FRAME)[:: audio.HOP]
    m = np.abs(np.fft.rfft(cut * np.hanning(audio.FRAME), axis=1))
    hertz = np.fft.rfftfreq(audio.FRAME, 1 / RATE)
    one = audio.signal_features(spark.createDataFrame([(1, float(RATE), y.tolist())], "clip int, rate double, y array<double>")).first()["features"]
    total = np.maximum(m.sum(axis=1), 1e-12)
    assert one["spectral_centroid"] == pytest.approx(((m * hertz).sum(axis=1) / total).mean())
    heard = m.sum(axis=1) > 0
    rolled = np.where(heard, hertz[(np.cumsum(m, axis=1) >= 0.85 * total[:, None]).argmax(axis=1)], 0).mean()
    assert one["spectral_rolloff"] == pytest.approx(rolled, abs=20)
    classes = np.floor(12 * np.log2(np.maximum(hertz, 1) / 440.0) + 69.5).astype(int) % 12
    inside = (hertz > 27) & (hertz < 5000)
    assert one["chroma"] == pytest.approx([m[:, inside & (classes == k)].sum(axis=1).mean() for k in range(12)])


def written_by(spark, work):
    """Bytes that stand in the checkpoint folder after ``work`` and did not before."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = size()
    out = work()
    return size() - before, out


def test_features_write_a_row_a_frame(spark):
    """neither samples nor spectra are written: of 40 clips of 22 frames, less than their files hold."""
    raw = [audio.encode_wav(0.8 * tone(200 + 10 * k, 0.6), RATE) for k in range(40)]
    files = spark.createDataFrame([(f"{k}.wav", 0.0, r) for k, r in enumerate(raw)], "path string, mtime double, content binary")
    grown, rows = written_by(spark, lambda: audio.with_features(files).collect())
    assert len(rows) == 40 and all(r["features"]["voiced_ratio"] > 0.9 for r in rows)
    assert grown < sum(map(len, raw))


def test_contents_reach_a_worker_in_bounded_batches(spark):
    """of 6,000 clips a worker holds a thousand or so at once, whatever the session's batches are."""
    d = f"{spark.conf.get('spark.checkpoint.dir')}/many"
    spark.range(6000).coalesce(1).selectExpr("id as vec_id", "0 as label", "array(0.5d) as embedding").write.mode("overwrite").parquet(f"{d}/embeddings.parquet")
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, "10000")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        found = audio_queries.probe_duration(spark, d)
        assert found.count() == 6000
        held = audio_queries.clips(spark, d).mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in held) == 6000 and max(r["n"] for r in held) <= 1024 and max(r["size"] for r in held) <= 16 << 20
    finally:
        spark.conf.set(most, before)


def query_writes_less_than_its_clips(spark, name):
    spark.range(64).selectExpr("id as vec_id", "cast(id % 10 as int) as label", "array(0.5d) as embedding").write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/clips/embeddings.parquet")
    d = f"{spark.conf.get('spark.checkpoint.dir')}/clips"
    held = audio_queries.clips(spark, d).agg(F.sum(F.length("content"))).first()[0]
    grown, rows = written_by(spark, lambda: audio_queries.queries()[name](spark, d).collect())
    assert len(rows) == 64 and grown < held
    return rows


def test_classify_audio_writes_a_row_a_frame(spark):
    """the classifier end to end."""
    rows = query_writes_less_than_its_clips(spark, "classify_audio")
    assert {r["kind"] for r in rows} == {"one-shot"} and {r["backend"] for r in rows} == {"auto"}


def test_clip_analysis_writes_a_row_a_frame(spark):
    """tempo, warp and key of each clip."""
    assert {r["source"] for r in query_writes_less_than_its_clips(spark, "clip_analysis")} == {"tempo_analysis"}


def test_pitches_frame_by_frame():
    t = np.arange(audio.FRAME) / audio.PITCH_RATE
    found = audio.pitches(np.array([np.sin(2 * np.pi * 220 * t), np.zeros(audio.FRAME), np.sin(2 * np.pi * 441 * t), np.random.default_rng(1).standard_normal(audio.FRAME)]))
    assert abs(found[0] - 220) < 2 and abs(found[2] - 441) < 5 and np.isnan(found[[1, 3]]).all()


def test_classify_and_render(spark, folder):
    found = audio.with_features(audio.read_files(spark, str(folder))).withColumn("kind", F.lit("one-shot"))
    tags = {r["filename"]: r for r in scan.classify(found, recognisers.verdicts(found, "auto"), "auto").collect()}
    assert tags["kick_01.wav"]["category"] == "kick" and "drums" in tags["kick_01.wav"]["instruments"]
    assert tags["broken.wav"]["category"] is None and tags["a.wav"]["kind"] == "unknown"
    loops = {r["path"].rsplit("/", 1)[-1]: r["duration"] for r in audio.with_durations(audio.loop_render(audio.read_files(spark, str(folder)))).collect()}
    assert abs(loops["kick_01.wav"] - 4.3) < 0.01
    assert {r["source"] for r in audio.analyse_clip(found).collect()} == {"filename", "tempo_analysis"}


def test_recognisers(spark):
    with pytest.raises(BadInputError):
        recognisers.recogniser("none")
    assert recognisers.backends() == ["ace-step", "heuristic"] and recognisers.select("auto", ["path"]) == ["heuristic"]
    assert recognisers.select("auto", ["path", "caption"]) == ["ace-step", "heuristic"]
    with pytest.raises(BackendError):
        recognisers.select("ace-step", ["path"])

    def captioner():
        def said(paths):
            if any("bad" in p for p in paths):
                raise ValueError(paths)
            return [f"a kick in {p}" for p in paths]

        return said

    files = spark.createDataFrame([("a",), ("bad",), ("c",)], "path string").coalesce(1)
    assert [r["caption"] for r in recognisers.with_captions(files, captioner).collect()] == ["a kick in a", None, "a kick in c"]


def test_stream(spark, folder, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/cat")
    first = lambda df: scan.classify(audio.with_features(df), None, "auto")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.follow(spark, str(folder)), store, first, str(tmp_path / "ck")).awaitTermination()
        assert store.tags.count() == 4
    assert store.get(next(r["path"] for r in store.tags.collect() if "kick" in r["path"])).first()["category"] == "kick"


def test_signals(spark):
    df = spark.createDataFrame([([0.0, 1.0, -2.0, 1.0],), ([],)], "y array<double>")
    y = F.col("y")
    got = df.select(signal.energy(y), signal.zero_crossing_rate(y), signal.log_attack_time(y, 2.0), signal.pitch_stability(y)).collect()
    assert tuple(got[0])[:3] == (6.0, 0.5, 0.0) and got[1][2] == -3.0 and got[1][3] == 1.0
    made = df.select(signal.four_on_the_floor(y, 2, 3)).first()[0]
    assert np.allclose(made, np.array([0, 1, -2, 2, -2, 2, -2, 1, 0, 0]) / 2)
    flat = spark.createDataFrame([([1.0] * 12,)], "c array<double>").select(signal.detect_key(F.col("c"))).first()[0]
    assert tuple(flat) == ("C", "major")
    assert rules is not None
