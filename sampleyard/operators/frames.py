"""Signal features as relations: frames of a clip, their spectra as rows, and all else by windows and grouping.

``samples(clip, at, value)`` or ``signals(clip, y)`` become ``frames(clip, frame, y)`` of ``size``
samples every ``hop``; the last frame is the last whole one, and a clip shorter than a frame is padded with
zeros.  A helper transforms one frame at a time (:func:`spectra`), and ``bins(clip, frame, bin, magnitude)``
holds a row for each frequency.  From there on Spark does the work: rises and running medians by row
frames, peaks by neighbours, tempo by lagged products, chroma and roll-off by grouping and running sums.

No window holds a whole clip: frames are dealt into chunks that overlap by what a window reaches
(:func:`chunked`), so one clip with most of the frames is spread over many tasks.  Statistics of a clip
are aggregates that are joined back, one row for each clip.

Where a signal is at hand as a whole array, :func:`frame_rows` gives what needs the frame and those beside it alone, so that neither spectra nor
bins are ever written or shuffled; a row a frame remains.

Defined results: nulls among samples count as zero; a clip without samples has no frames, so no row;
repeated (clip, at) pairs are not allowed; clips may be of any type, null excepted (such rows are left out).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a clip that one window holds, without what it overlaps.
CHUNK = 512


def frames_of_samples(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """(clip, frame, y) of ``samples(clip, at, value)`` with places from 0 on, gapless."""
    first = F.greatest(F.lit(0), F.floor((F.col("at") - size) / hop) + 1)
    dealt = samples.where(F.col("clip").isNotNull()).select("clip", "at", F.coalesce("value", F.lit(0.0)).alias("value"), F.explode(F.sequence(first, F.floor(F.col("at") / hop))).alias("frame"))
    made = dealt.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("y"))  # one frame's samples
    whole = (F.size("y") == size) | (F.col("frame") == 0)
    return made.where(whole).select("clip", "frame", F.concat("y", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("y"))).alias("y"))


def frames_of_signals(signals: DataFrame, size: int, hop: int) -> DataFrame:
    """(clip, frame, y) of ``signals(clip, y)``, each a whole array; columns besides come along."""
    y = F.col("y")
    padded = F.concat(y, F.array_repeat(F.lit(0.0).cast(signals.schema["y"].dataType.elementType), F.greatest(F.lit(0), F.lit(size) - F.size(y))))
    last = F.floor(F.greatest(F.size(y) - size, F.lit(0)) / hop)
    rows = signals.where(F.col("clip").isNotNull() & (F.size(y) > 0)).withColumn("y", padded)
    return rows.withColumn("frame", F.explode(F.sequence(F.lit(0), last))).withColumn("y", F.slice("y", F.col("frame").cast("int") * hop + 1, size))


def _merged(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Two sorted lists of arrays, of equal length that is a power of two, as one list that is sorted at each place (odd-even merging)."""
    if len(x) == 1:
        return [np.minimum(x[0], y[0]), np.maximum(x[0], y[0])]
    even, odd = _merged(x[::2], y[::2]), _merged(x[1::2], y[1::2])
    between = [f(a, b) for a, b in zip(odd[:-1], even[1:], strict=True) for f in (np.minimum, np.maximum)]
    return [even[0], *between, odd[-1]]


def _whole_windows(x: np.ndarray, half: int) -> np.ndarray:
    """Medians along the first axis of the windows of ``2 * half + 1`` rows that lie within ``x``.

    Two neighbouring windows share ``2 * half`` rows: of these the two in the middle are found once, by merging sorted
    runs that later windows share as well, and either window's last row is put between them.
    """
    n = len(x) - 2 * half
    if half & (half - 1):  # no power of two
        return np.median(np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1, axis=0), axis=-1)
    x = np.concatenate([x, x[-1:]]) if n % 2 else x  # an even number of windows
    even, odd = x[::2].copy(), x[1::2].copy()
    # runs of two rows from row 1 on, at every second row; then of four, eight, ...
    runs, apart = _merged([odd[:-1]], [even[1:]]), 1
    while len(runs) < half:
        runs, apart = _merged([r[:-apart] for r in runs], [r[apart:] for r in runs]), 2 * apart
    if half == 1:
        low, high = runs
    else:
        first, second = [r[:-apart] for r in runs], [r[apart:] for r in reversed(runs)]
        low, high = np.minimum(first[0], second[0]), np.maximum(first[0], second[0])
        for a, b in zip(first[1:], second[1:], strict=True):
            np.maximum(low, np.minimum(a, b), out=low)
            np.minimum(high, np.maximum(a, b), out=high)
    out = np.empty((2 * len(low), *x.shape[1:]))
    out[::2] = np.minimum(np.maximum(even[: len(low)], low), high)
    out[1::2] = np.minimum(np.maximum(odd[half : half + len(low)], low), high)
    return out[:n]


def medians(x: np.ndarray, width: int) -> np.ndarray:
    """Running medians along the first axis, of what there is of a window at the ends (the mean of two middle values)."""
    half = width // 2
    if not half or not x.size:
        return x.astype(np.float64)
    # infinities of changing sign beyond the ends leave a window's median, or its upper middle value where the lower is with the signs changed
    signs = np.where(np.arange(half) % 2, -np.inf, np.inf).reshape(-1, *[1] * (x.ndim - 1)) * np.ones((1, *x.shape[1:]))
    middle, other = (lambda rows, s=s: _whole_windows(np.concatenate([s * signs[::-1], rows, -s * signs]), half) for s in (1, -1))
    found = middle(x)
    if len(x) <= 4 * half:
        return (found + other(x)) / 2
    found[:half] = (found[:half] + other(x[: 2 * half])[:half]) / 2
    found[-half:] = (found[-half:] + other(x[-2 * half :])[-half:]) / 2
    return found


def smoothed(magnitudes: np.ndarray, width: int) -> np.ndarray:
    """Running medians along each row, of what there is of a window at its ends."""
    return np.ascontiguousarray(medians(np.ascontiguousarray(magnitudes.T), width).T)


#: Frames that :func:`frame_rows` works on at once, without what they overlap.
TOGETHER = 64
BANDS = 7


def frame_rows(y: np.ndarray, step: float, size: int, hop: int, also: Callable[[np.ndarray], np.ndarray], width: int = 17, gain: float = 100.0) -> Iterator[dict[str, np.ndarray]]:
    """Numbers of the frames of one signal, some frames at a time, each with the frames that its medians reach.

    ``frame`` is its number; ``rise``, ``p`` and ``h`` are as of :func:`textures`, ``centroid`` and ``rolloff`` as of :func:`shapes`, ``chroma``
    and ``spreads`` the sums and spreads of which :func:`chroma` and :func:`contrasts` take means and variances, all for
    spectra whose bins are ``step`` hertz apart; ``also`` gives the pitch of each of an array of frames.
    """
    y = np.pad(y, (0, max(0, size - len(y))))
    cut = np.lib.stride_tricks.sliding_window_view(y, size)[::hop]
    window, half, hertz = np.hanning(size), width // 2, np.arange(size // 2 + 1) * step
    with np.errstate(divide="ignore"):
        classes = np.floor(12 * np.log2(hertz / 440.0) + 69 + 0.5)
    inside = (hertz > 27.0) & (hertz < 5000.0)
    pitched = ((np.where(inside, classes, 0)[:, None] % 12 == np.arange(12)) & inside[:, None]).astype(np.float64)
    high = int(np.searchsorted(hertz, 8000.0))
    ends = np.cumsum([0, *(high // BANDS + (k < high % BANDS) for k in range(min(BANDS, high)))])
    for at in range(0, len(cut), TOGETHER):
        own, seen = slice(at, min(at + TOGETHER, len(cut))), slice(max(0, at - half), at + TOGETHER + half)
        around = np.abs(np.fft.rfft(cut[seen] * window, axis=1))
        place = slice(own.start - seen.start, own.stop - seen.start)
        m, along = around[place], medians(around, width)[place]
        across = smoothed(m, width)
        level = np.log1p(gain * around[max(0, place.start - 1) : place.stop])
        grown = np.maximum(0.0, np.diff(level, axis=0)).mean(axis=1)
        soft = across**2 / np.maximum(across**2 + along**2, 1e-12)
        so_far = np.cumsum(m, axis=1)
        total = so_far[:, -1]
        floor = np.maximum(total, 1e-12)
        over = (so_far >= 0.85 * floor[:, None]) | (so_far >= total[:, None])
        order = np.log(np.maximum(np.sort(m[:, :high], axis=1), 1e-9))
        yield {
            "frame": np.arange(own.start, own.stop), "rise": np.concatenate([[np.nan], grown]) if at == 0 else grown, "p": ((m * soft) ** 2).sum(axis=1), "h": ((m * (1 - soft)) ** 2).sum(axis=1),
            "centroid": m @ hertz / floor, "rolloff": np.where(total > 0, hertz[over.argmax(axis=1)], 0.0), "pitch": also(cut[own]), "chroma": m @ pitched, "spreads": order[:, ends[1:] - 1] - order[:, ends[:-1]],
        }


def spectra(frames: DataFrame, size: int, also: Callable[[np.ndarray], np.ndarray] | None = None, name: str = "also", smooth: int | None = None) -> DataFrame:
    """``frames`` with ``magnitudes`` instead of ``y``: of each frame by itself, under a Hann window.

    ``also`` gives one more number of each frame (rows of an array), for the column ``name``; ``smooth`` the
    width of running medians over a frame's magnitudes, for the column ``smoothed``.
    """
    keep = [c for c in frames.columns if c != "y"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(keep).schema.fields)
    window = np.hanning(size)
    added = [*([name] if also else []), "magnitudes", *(["smoothed"] if smooth else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 64) for at in range(0, b.num_rows, 64)):
                y = part.column(len(keep)).flatten().to_numpy().astype(np.float64).reshape(-1, size)
                found = np.abs(np.fft.rfft(y * window, axis=1))
                ends = pa.array(np.arange(len(y) + 1) * found.shape[1], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (found, *([smoothed(found, smooth)] if smooth else []))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *([pa.array(also(y))] if also else []), *lists], names=[*keep, *added])

    kinds = [f"`{name}` double" if c == name and also else f"{c} array<double>" for c in added]
    return frames.select(*keep, "y").mapInArrow(run, ", ".join([schema, *kinds]))


def bins(spectra: DataFrame) -> DataFrame:
    """A row for each frequency: ``bin`` and ``magnitude`` instead of ``magnitudes``, and ``across`` instead of ``smoothed`` where that is there."""
    keep = [c for c in spectra.columns if c not in ("magnitudes", "smoothed")]
    if "smoothed" not in spectra.columns:
        return spectra.select(*keep, F.posexplode("magnitudes").alias("bin", "magnitude"))
    return spectra.select(*keep, F.posexplode(F.arrays_zip("magnitudes", "smoothed")).alias("bin", "__x")).select(*keep, "bin", F.col("__x.magnitudes").alias("magnitude"), F.col("__x.smoothed").alias("across"))


def chunked(rows: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """``rows(clip, frame, ...)`` dealt into chunks of frames, ``__chunk``; frames that windows of the next or last chunk reach are there too, with ``__own`` false."""
    own, at = F.floor(F.col("frame") / chunk), F.col("frame") % chunk
    if max(before, after) > chunk:
        raise ValueError("a window reaches over one chunk at most")
    back = F.when((at < after) & (own > 0), own - 1)  # the chunk before sees this frame ahead of it
    on = F.when(at >= chunk - before, own + 1)
    return rows.withColumn("__chunk", F.explode(F.array_compact(F.array(own, back, on)))).withColumn("__own", F.col("__chunk") == own)


def over_frames(*keys: str) -> Window:
    return Window.partitionBy("clip", *keys, "__chunk").orderBy("frame")


def _owned(rows: DataFrame) -> DataFrame:
    return rows.where("__own").drop("__own", "__chunk")


def rises(bins: DataFrame, gain: float = 100.0) -> DataFrame:
    """(clip, frame, rise) from the second frame on: the mean growth of log magnitudes over the frame before."""
    level = F.log1p(gain * F.col("magnitude"))
    grown = chunked(bins.select("clip", "frame", "bin", level.alias("level")), 1, 0)
    grown = _owned(grown.withColumn("grown", F.greatest(F.lit(0.0), F.col("level") - F.lag("level").over(over_frames("bin")))).where(F.col("frame") > 0))
    return grown.groupBy("clip", "frame").agg(F.avg("grown").alias("rise"))


def onsets(rises: DataFrame, near: int = 3, around: int = 10, delta: float = 0.07) -> DataFrame:
    """``rises`` with ``peak``: the greatest of its neighbourhood, and above the mean around it by a share of the clip's greatest."""
    top = rises.groupBy("clip").agg(F.max("rise").alias("__top"))
    window = over_frames()
    beside, wide = (window.rowsBetween(-n, n) for n in (near, around))
    found = chunked(rises, around, around)
    found = _owned(found.select("*", F.max("rise").over(beside).alias("__near"), F.avg("rise").over(wide).alias("__mean")))
    peak = (F.col("rise") == F.col("__near")) & (F.col("rise") > F.col("__mean") + delta * F.greatest("__top", F.lit(1e-9)))
    return found.join(top, "clip").select("clip", "frame", "rise", peak.alias("peak"))


def tempos(rises: DataFrame, frame_rate: Column | float, slowest: float = 30.0, fastest: float = 300.0, usual: float = 120.0, max_lag: int = CHUNK) -> DataFrame:
    """(clip, tempo): beats a minute of the lag whose products of centred rises, weighted log-normally about ``usual``, are greatest; 0 without any rise.

    ``frame_rate`` is frames a second, a number or a column of ``rises``; lags go up to ``max_lag`` frames.
    """
    rate = frame_rate if isinstance(frame_rate, Column) else F.lit(float(frame_rate))
    stats = rises.groupBy("clip").agg(F.avg("rise").alias("__mean"), F.max(rate).alias("__rate"), F.var_pop("rise").alias("__spread"), F.count("*").alias("__n"))
    centred = rises.select("clip", "frame", "rise").join(stats.select("clip", "__mean"), "clip").select("clip", "frame", (F.col("rise") - F.col("__mean")).alias("c"))
    ahead = chunked(centred, 0, max_lag, max(CHUNK, max_lag))
    ahead = _owned(ahead.withColumn("next", F.collect_list("c").over(over_frames().rowsBetween(1, max_lag))))
    lags = ahead.select("clip", "c", F.posexplode("next").alias("__at", "d")).groupBy("clip", (F.col("__at") + 1).alias("lag")).agg(F.sum(F.col("c") * F.col("d")).alias("product"))
    beats = 60.0 * F.col("__rate") / F.col("lag")
    octaves = F.log2(beats / usual)
    weighed = lags.join(stats, "clip").withColumn("weight", F.when(beats.between(slowest, fastest), F.col("product") * F.exp(-0.5 * octaves * octaves)).otherwise(0.0)).withColumn("beats", beats)
    # of equal weights the shortest lag
    best = weighed.groupBy("clip").agg(F.max_by("beats", F.struct("weight", -F.col("lag"))).alias("beats"), F.max("weight").alias("weight"))
    known = (F.col("__spread") > 0) & (F.col("weight") > 0)
    return stats.join(best, "clip", "left").select("clip", F.when(known, F.col("beats")).otherwise(0.0).alias("tempo"))


def _middle(values: Column) -> Column:
    """The median of an array."""
    order = F.array_sort(values)
    return (F.get(order, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(order, F.floor(F.size(values) / 2).cast("int"))) / 2


def percussive(bins: DataFrame, width: int = 17) -> DataFrame:
    """(clip, ratio): the share of energy that is smooth in frequency rather than in time, by soft masks of running medians; 0 of silence."""
    return ratios(textures(bins, width))


def textures(bins: DataFrame, width: int = 17, gain: float = 100.0) -> DataFrame:
    """(clip, frame, rise, p, h): of each frame what :func:`rises` gives (null for a clip's first), and its percussive and harmonic energy.

    One sort of the bins in time and one in frequency serve all three; where the bins have their medians over frequency
    (``across``, of the same width), the second is not needed.
    """
    half = width // 2
    level = F.log1p(gain * F.col("magnitude"))
    time = over_frames("bin")
    known = ["across"] if "across" in bins.columns else []
    rows = chunked(bins.select("clip", "frame", "bin", "magnitude", *known), half, half)
    rows = _owned(rows.select("*", F.collect_list("magnitude").over(time.rowsBetween(-half, half)).alias("along"), F.lag("magnitude").over(time).alias("before")))
    in_frame = Window.partitionBy("clip", "frame").orderBy("bin").rowsBetween(-half, half)
    across = F.col("across") if known else _middle(F.collect_list("magnitude").over(in_frame))
    grown = F.when(F.col("frame") > 0, F.greatest(F.lit(0.0), level - F.log1p(gain * F.col("before"))))
    both = rows.select("clip", "frame", "magnitude", grown.alias("grown"), _middle(F.col("along")).alias("a"), across.alias("b"))
    soft = F.col("b") * F.col("b") / F.greatest(F.col("b") * F.col("b") + F.col("a") * F.col("a"), F.lit(1e-12))
    m = F.col("magnitude")
    parts = both.select("clip", "frame", "magnitude", "grown", soft.alias("soft")).groupBy("clip", "frame")
    return parts.agg(F.avg("grown").alias("rise"), F.sum(F.pow(m * F.col("soft"), F.lit(2))).alias("p"), F.sum(F.pow(m * (1 - F.col("soft")), F.lit(2))).alias("h"))


def ratios(textures: DataFrame) -> DataFrame:
    """(clip, ratio) of :func:`textures`."""
    sums = textures.groupBy("clip").agg(F.sum("p").alias("p"), F.sum("h").alias("h"))
    return sums.select("clip", F.when(F.col("p") + F.col("h") > 0, F.col("p") / (F.col("p") + F.col("h"))).otherwise(0.0).alias("ratio"))


def chroma(bins: DataFrame, step: Column, low: float = 27.0, high: float = 5000.0, tuning: float = 440.0) -> DataFrame:
    """(clip, pitch_class 0..11, energy): each pitch class' mean over frames of its bins' summed magnitudes; classes without bins are 0.

    ``step`` is the hertz between bins.
    """
    hertz = F.col("bin") * step
    number = F.floor(12 * F.log2(hertz / tuning) + 69 + 0.5)
    counts = bins.groupBy("clip").agg(F.count_if(F.col("bin") == 0).alias("__n"))
    heard = bins.where((hertz > low) & (hertz < high)).groupBy("clip", F.pmod(number, F.lit(12)).cast("int").alias("pitch_class")).agg(F.sum("magnitude").alias("__sum"))
    every = counts.withColumn("pitch_class", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return every.join(heard, ["clip", "pitch_class"], "left").select("clip", "pitch_class", (F.coalesce("__sum", F.lit(0.0)) / F.col("__n")).alias("energy"))


def shapes(bins: DataFrame, step: Column, share: float = 0.85) -> DataFrame:
    """(clip, centroid, rolloff): means over frames of the magnitudes' centre, and of the frequency below which ``share`` of them lies."""
    hertz = F.col("bin") * step
    frame = Window.partitionBy("clip", "frame")
    rows = bins.select("clip", "frame", hertz.alias("hertz"), "magnitude", F.sum("magnitude").over(frame.orderBy("bin")).alias("__so_far"), F.sum("magnitude").over(frame).alias("__total"))
    floor = F.greatest("__total", F.lit(1e-12))
    # the running sum's last value and the total may differ in the last place: the last bin always counts
    over = (F.col("__so_far") >= share * floor) | (F.col("__so_far") >= F.col("__total"))
    by_frame = rows.groupBy("clip", "frame").agg((F.sum(F.col("magnitude") * F.col("hertz")) / F.max(floor)).alias("centroid"), F.min(F.when(over & (F.col("__total") > 0), F.col("hertz"))).alias("rolloff"))
    return by_frame.groupBy("clip").agg(F.avg("centroid").alias("centroid"), F.avg(F.coalesce("rolloff", F.lit(0.0))).alias("rolloff"))


def contrasts(bins: DataFrame, step: Column, high: float = 8000.0, bands: int = 7) -> DataFrame:
    """(clip, contrast): of ``bands`` equal shares of each frame's magnitudes by size, the variance over frames of log greatest less log least, averaged."""
    order = Window.partitionBy("clip", "frame").orderBy("magnitude", "bin")
    level = F.log(F.greatest("magnitude", F.lit(1e-9)))
    rows = bins.where(F.col("bin") * step < high).select("clip", "frame", level.alias("level"), F.ntile(bands).over(order).alias("band"))
    spread = rows.groupBy("clip", "frame", "band").agg((F.max("level") - F.min("level")).alias("spread"))
    return spread.groupBy("clip", "band").agg(F.var_pop("spread").alias("v")).groupBy("clip").agg(F.avg("v").alias("contrast"))


def numbered(rows: DataFrame, key: str, order: list[str], coarse: Column) -> DataFrame:
    """``rows`` with ``at``, their place from 0 on within ``key`` by ``order``.

    ``coarse`` is a value that never falls along ``order``, such as its day: places are counted within it and the counts of
    the ones before added, so that no task has to hold all rows of a key.
    """
    found = rows.withColumn("__coarse", coarse)
    sums = found.groupBy(key, "__coarse").count()
    before = sums.select(key, "__coarse", (F.sum("count").over(Window.partitionBy(key).orderBy("__coarse")) - F.col("count")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(key, "__coarse").orderBy(*order)) - 1
    return found.withColumn("__place", place).join(before, [key, "__coarse"]).withColumn("at", F.col("__before") + F.col("__place")).drop("__coarse", "__place", "__before")

