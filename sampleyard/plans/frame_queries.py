"""Queries over signals as frame rows: each user's event values, in the order of time, are a clip.

In SQL a frame's spectrum is the plain sum of its products with sines and cosines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames
from .projections import projected, with_projections

#: Samples of a frame and between frames; hertz between bins where pitches matter, and frames a second where tempo does.
SIZE, HOP, STEP, FRAME_RATE = 16, 4, 110.0, 4.0

_SPECTRA = f"""with s as (select clip, row_number() over (partition by clip order by ts, event_id) - 1 as at, coalesce(value, 0) as value from lib_series where clip is not null),
n as (select clip, count(*) as n from s group by 1),
f as (select clip, unnest(range(0, 1 + greatest(0, n - {SIZE}) // {HOP})) as frame from n),
x as (select f.clip, frame, i, coalesce(s.value, 0) * (0.5::double - 0.5::double * cos(2 * pi() * i / {SIZE - 1})) as v from f cross join range({SIZE}) t(i) left join s on s.clip = f.clip and s.at = frame * {HOP} + i),
bins as (select clip, frame, b as bin, sqrt(pow(sum(v * cos(2 * pi() * b * i / {SIZE})), 2) + pow(sum(v * sin(2 * pi() * b * i / {SIZE})), 2)) as m from x cross join range({SIZE // 2 + 1}) u(b) group by 1, 2, 3)"""
_RISES = f"""{_SPECTRA},
grown as (select clip, frame, greatest(0, ln(1 + 100 * m) - lag(ln(1 + 100 * m)) over (partition by clip, bin order by frame)) as g from bins),
rises as (select clip, frame, avg(g) as rise from grown where frame > 0 group by 1, 2)"""


def _bins(spark: SparkSession, d: str) -> DataFrame:
    series = projected(spark, d, "lib_series")
    samples = frames.numbered(series.where(F.col("clip").isNotNull()), "clip", ["ts", "event_id"], F.to_date("ts"))
    return frames.bins(frames.spectra(frames.frames_of_samples(samples, SIZE, HOP), SIZE))


def frame_onsets(spark: SparkSession, d: str) -> DataFrame:
    found = frames.onsets(frames.rises(_bins(spark, d)))
    return found.groupBy("clip").agg(F.count_if("peak").alias("n_onsets"), F.round(F.avg("rise"), 6).alias("mean_rise"), F.round(F.max(F.when(F.col("peak"), F.col("frame"))), 6).cast("long").alias("last_onset"))


ONSETS = f"""{_RISES},
near as (select *, max(rise) over (partition by clip order by frame rows between 3 preceding and 3 following) as beside, avg(rise) over (partition by clip order by frame rows between 10 preceding and 10 following) as around, max(rise) over (partition by clip) as top from rises),
peaks as (select *, rise = beside and rise > around + 0.07::double * greatest(top, 1e-9) as peak from near)
select clip, count_if(peak)::bigint as n_onsets, round(avg(rise), 6) as mean_rise, max(case when peak then frame end)::bigint as last_onset from peaks group by 1"""


def frame_tempo(spark: SparkSession, d: str) -> DataFrame:
    return frames.tempos(frames.rises(_bins(spark, d)), FRAME_RATE).select("clip", F.round("tempo", 6).alias("tempo"))


TEMPO = f"""{_RISES},
stats as (select clip, avg(rise) as mean, var_pop(rise) as spread from rises group by 1),
c as (select clip, frame, rise - mean as c from rises join stats using (clip)),
lags as (select a.clip, b.frame - a.frame as lag, sum(a.c * b.c) as product from c a join c b on a.clip = b.clip and b.frame > a.frame group by 1, 2),
w as (select clip, lag, 60.0::double * {FRAME_RATE} / lag as beats, product from lags),
v as (select clip, lag, beats, case when beats between 30 and 300 then product * exp(-0.5::double * pow(log2(beats / 120), 2)) else 0 end as weight from w),
best as (select clip, beats, weight from v qualify row_number() over (partition by clip order by weight desc, lag) = 1)
select clip, round(case when spread > 0 and weight > 0 then beats else 0 end, 6) as tempo from stats left join best using (clip)"""


def frame_percussive(spark: SparkSession, d: str) -> DataFrame:
    return frames.percussive(_bins(spark, d), width=5).select("clip", F.round("ratio", 6).alias("percussive_ratio"))


PERCUSSIVE = f"""{_SPECTRA},
med as (select clip, m, median(m) over (partition by clip, bin order by frame rows between 2 preceding and 2 following) as a, median(m) over (partition by clip, frame order by bin rows between 2 preceding and 2 following) as h from bins),
soft as (select clip, m, h * h / greatest(h * h + a * a, 1e-12) as s from med),
parts as (select clip, sum(pow(m * s, 2)) as p, sum(pow(m * (1 - s), 2)) as h from soft group by 1)
select clip, round(case when p + h > 0 then p / (p + h) else 0 end, 6) as percussive_ratio from parts"""


def frame_chroma(spark: SparkSession, d: str) -> DataFrame:
    return frames.chroma(_bins(spark, d), F.lit(STEP)).select("clip", "pitch_class", F.round("energy", 6).alias("energy"))


CHROMA = f"""{_SPECTRA},
held as (select clip, count(*) as n from bins where bin = 0 group by 1),
heard as (select clip, ((floor(12 * log2(bin * {STEP} / 440) + 69.5)::int % 12) + 12) % 12 as pitch_class, sum(m) as s from bins where bin * {STEP} > 27 and bin * {STEP} < 5000 group by 1, 2)
select held.clip, k::int as pitch_class, round(coalesce(s, 0) / n, 6) as energy from held cross join range(12) t(k) left join heard on heard.clip = held.clip and heard.pitch_class = k"""


def frame_rolloff(spark: SparkSession, d: str) -> DataFrame:
    return frames.shapes(_bins(spark, d), F.lit(STEP)).select("clip", F.round("centroid", 6).alias("centroid"), F.round("rolloff", 6).alias("rolloff"))


ROLLOFF = f"""{_SPECTRA},
run as (select clip, frame, bin * {STEP} as hz, m, sum(m) over (partition by clip, frame order by bin) as so_far, sum(m) over (partition by clip, frame) as total from bins),
by_frame as (select clip, frame, sum(m * hz) / max(greatest(total, 1e-12)) as centroid, coalesce(min(case when total > 0 and (so_far >= 0.85::double * total or so_far >= total) then hz end), 0) as rolloff from run group by 1, 2)
select clip, round(avg(centroid), 6) as centroid, round(avg(rolloff), 6) as rolloff from by_frame group by 1"""


def frame_contrast(spark: SparkSession, d: str) -> DataFrame:
    return frames.contrasts(_bins(spark, d), F.lit(STEP), high=5000.0, bands=3).select("clip", F.round("contrast", 6).alias("contrast"))


CONTRAST = f"""{_SPECTRA},
banded as (select clip, frame, ln(greatest(m, 1e-9)) as level, ntile(3) over (partition by clip, frame order by m, bin) as band from bins where bin * {STEP} < 5000),
spread as (select clip, frame, band, max(level) - min(level) as s from banded group by 1, 2, 3)
select clip, round(avg(v), 6) as contrast from (select clip, band, var_pop(s) as v from spread group by 1, 2) group by 1"""

QUERIES = {f.__name__: f for f in (frame_onsets, frame_tempo, frame_percussive, frame_chroma, frame_rolloff, frame_contrast)}
ORACLES = {
    "frame_onsets": with_projections(ONSETS),
    "frame_tempo": with_projections(TEMPO),
    "frame_percussive": with_projections(PERCUSSIVE),
    "frame_chroma": with_projections(CHROMA),
    "frame_rolloff": with_projections(ROLLOFF),
    "frame_contrast": with_projections(CONTRAST),
}
