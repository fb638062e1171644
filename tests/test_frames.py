"""Signals as frame rows: against plain numpy, across chunks, and with odd samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleyard.operators import frames


def samples(spark, clips):
    rows = [(c, k, float(v)) for c, y in clips.items() for k, v in enumerate(y)]
    return spark.createDataFrame(rows, "clip string, at long, value double")


def test_frames_of_samples_and_of_arrays_agree(spark):
    rng = np.random.default_rng(0)
    clips = {f"c{n}": rng.normal(size=n) for n in (1, 7, 8, 9, 12, 40)}
    apart = frames.frames_of_samples(samples(spark, clips), 8, 3)
    whole = frames.frames_of_signals(spark.createDataFrame([(c, y.tolist()) for c, y in clips.items()] + [("none", []), (None, [1.0])], "clip string, y array<double>"), 8, 3)
    got = sorted((r["clip"], r["frame"], r["y"]) for r in apart.collect())
    assert got == sorted((r["clip"], r["frame"], r["y"]) for r in whole.select("clip", "frame", "y").collect())
    want = []
    for c, y in clips.items():
        padded = np.pad(y, (0, max(0, 8 - len(y))))
        want += [(c, f, padded[3 * f : 3 * f + 8].tolist()) for f in range(1 + max(0, len(y) - 8) // 3)]
    assert got == sorted(want)


@pytest.fixture(scope="module")
def spectra(spark):
    rng = np.random.default_rng(3)
    made = {c: np.abs(rng.normal(size=(n, 6))) for c, n in {"a": 1, "b": 5, "c": 57}.items()}
    rows = [(c, f, b, float(m)) for c, x in made.items() for f, line in enumerate(x) for b, m in enumerate(line)]
    return made, spark.createDataFrame(rows, "clip string, frame long, bin int, magnitude double").cache()


@pytest.mark.parametrize("chunk", [4, 16, 512])
def test_windows_over_chunks_are_as_over_whole_clips(spark, spectra, monkeypatch, chunk):
    """However clips are dealt into chunks, medians and rises are those of the whole clip."""
    made, bins = spectra
    monkeypatch.setattr(frames, "CHUNK", chunk)
    monkeypatch.setattr(frames.chunked, "__defaults__", (chunk,))
    got = {r["clip"]: r["ratio"] for r in frames.percussive(bins, width=5).collect()}
    rise = {(r["clip"], r["frame"]): r["rise"] for r in frames.rises(bins).collect()}
    for c, x in made.items():
        def around(m, k):
            return np.median(m[max(0, k - 2) : k + 3], axis=0)

        along = np.array([around(x, k) for k in range(len(x))])
        across = np.array([[around(line, k) for k in range(6)] for line in x])
        soft = across**2 / (across**2 + along**2)
        p, h = ((x * soft) ** 2).sum(), ((x * (1 - soft)) ** 2).sum()
        assert got[c] == pytest.approx(p / (p + h))
        grown = np.maximum(0, np.diff(np.log1p(100 * x), axis=0)).mean(axis=1)
        assert [rise[c, k + 1] for k in range(len(grown))] == pytest.approx(grown.tolist())


def test_medians_over_frequency_in_a_frame_or_in_a_window(spark):
    rng = np.random.default_rng(4)
    for n, width in ((1, 5), (3, 5), (5, 5), (9, 5), (40, 17)):
        x = rng.random((3, n))
        want = [[np.median(line[max(0, k - width // 2) : k + width // 2 + 1]) for k in range(n)] for line in x]
        assert np.allclose(frames.smoothed(x, width), want)
    signals = spark.createDataFrame([("a", rng.normal(size=400).tolist()), ("b", rng.normal(size=70).tolist())], "clip string, y array<double>")
    cut = frames.frames_of_signals(signals, 64, 16)
    within, apart = (frames.textures(frames.bins(frames.spectra(cut, 64, smooth=s)), 17).orderBy("clip", "frame").collect() for s in (17, None))
    assert len(within) == len(apart) == 23
    for a, b in zip(within, apart, strict=True):
        assert a["p"] == pytest.approx(b["p"]) and a["h"] == pytest.approx(b["h"]) and a["rise"] == (b["rise"] if b["rise"] is None else pytest.approx(b["rise"]))


@pytest.mark.parametrize(("n", "width"), [(1, 3), (1, 17), (2, 17), (4, 5), (7, 7), (9, 17), (16, 17), (17, 17), (33, 17), (41, 17), (50, 9), (30, 11)])
def test_running_medians_by_merged_runs(n, width):
    """medians along the first axis, with shared sorted runs, are those of every window by itself."""
    x = np.random.default_rng(n).integers(0, 9, (n, 3)).astype(float)  # with equal values
    half = width // 2
    assert np.allclose(frames.medians(x, width), [np.median(x[max(0, k - half) : k + half + 1], axis=0) for k in range(n)])


@pytest.mark.parametrize("together", [3, 20, 64])
def test_rows_of_frames_are_as_by_bins(spark, monkeypatch, together):
    """what leaves a task as one row a frame is what the relations over bins give, wherever frames are parted."""
    monkeypatch.setattr(frames, "TOGETHER", together)
    y = np.random.default_rng(5).normal(size=1500)
    step = F.lit(110.0)
    made = [d for d in frames.frame_rows(y, 110.0, 64, 16, lambda x: x[:, 0])]
    got = {c: np.concatenate([d[c] for d in made]) for c in made[0]}
    bins = frames.bins(frames.spectra(frames.frames_of_signals(spark.createDataFrame([("a", y.tolist())], "clip string, y array<double>"), 64, 16), 64)).cache()
    rows = frames.textures(bins).orderBy("frame").collect()
    assert got["frame"].tolist() == list(range(len(rows))) and got["pitch"].tolist() == y[::16][: len(rows)].tolist()
    assert np.isnan(got["rise"][0]) and np.allclose(got["rise"][1:], [r["rise"] for r in rows[1:]])
    assert np.allclose(got["p"], [r["p"] for r in rows]) and np.allclose(got["h"], [r["h"] for r in rows])
    shape = frames.shapes(bins, step).first()
    assert got["centroid"].mean() == pytest.approx(shape["centroid"]) and got["rolloff"].mean() == pytest.approx(shape["rolloff"])
    assert np.allclose(got["chroma"].mean(axis=0), [r["energy"] for r in frames.chroma(bins, step).orderBy("pitch_class").collect()])
    assert got["spreads"].var(axis=0).mean() == pytest.approx(frames.contrasts(bins, step).first()["contrast"])


@pytest.mark.parametrize("chunk", [12, 512])
def test_onsets_and_tempo_by_plain_loops(spark, monkeypatch, chunk):
    monkeypatch.setattr(frames.chunked, "__defaults__", (chunk,))
    rng = np.random.default_rng(9)
    made = {"beat": np.where(np.arange(120) % 8 == 0, 1.0, 0.02 * rng.random(120)), "noise": rng.random(70), "flat": np.full(30, 0.5), "one": np.array([1.0])}
    rises = spark.createDataFrame([(c, f + 1, float(v)) for c, y in made.items() for f, v in enumerate(y)], "clip string, frame long, rise double")
    got = {}
    for r in frames.onsets(rises).where("peak").collect():
        got.setdefault(r["clip"], []).append(r["frame"])
    tempo = {r["clip"]: r["tempo"] for r in frames.tempos(rises, 16.0, max_lag=100).collect()}
    for c, y in made.items():
        want = [k + 1 for k in range(len(y)) if y[k] == y[max(0, k - 3) : k + 4].max() and y[k] > y[max(0, k - 10) : k + 11].mean() + 0.07 * y.max()]
        assert sorted(got.get(c, [])) == want
        centred = y - y.mean()
        weights = {}
        for lag in range(1, min(len(y), 101)):
            beats = 60 * 16.0 / lag
            if 30 <= beats <= 300:
                weights[lag] = (centred[:-lag] * centred[lag:]).sum() * np.exp(-0.5 * np.log2(beats / 120) ** 2)
        best = max(weights, key=weights.get) if weights and y.var() > 0 and max(weights.values()) > 0 else None
        assert tempo[c] == pytest.approx(60 * 16.0 / best if best else 0.0)
    assert tempo["beat"] == 120.0 and tempo["flat"] == 0.0


def test_one_clip_with_most_frames_is_spread(spark):
    """The rows of a long clip's windows lie in chunks of bounded size."""
    bins = spark.range(20_000).select(F.lit("long").alias("clip"), F.col("id").alias("frame"), F.lit(0).alias("bin"), F.rand(1).alias("magnitude"))
    sizes = [r["count"] for r in frames.chunked(bins, 10, 10).groupBy("clip", "__chunk").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= frames.CHUNK + 20
    with pytest.raises(ValueError, match="one chunk"):
        frames.chunked(bins, 10, 600)


def test_places_within_a_key(spark):
    rows = spark.createDataFrame([(k % 3, f"2024-01-0{1 + k % 5}", k) for k in range(60)], "clip int, day string, k int")
    got = frames.numbered(rows, "clip", ["day", "k"], F.col("day")).collect()
    for c in range(3):
        assert [r["at"] for r in sorted((r for r in got if r["clip"] == c), key=lambda r: (r["day"], r["k"]))] == list(range(20))


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "clip string, at long, value double")
    bins = frames.bins(frames.spectra(frames.frames_of_samples(none, 8, 4), 8))
    assert [f.count() for f in (frames.rises(bins), frames.percussive(bins), frames.chroma(bins, F.lit(1.0)), frames.shapes(bins, F.lit(1.0)), frames.tempos(frames.rises(bins), 4.0))] == [0] * 5
