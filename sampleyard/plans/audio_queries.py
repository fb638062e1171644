"""Queries over rendered audio: short clips made of table rows, then read as files are (SQL for their durations only)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recognisers, scan
from ..sources import audio
from ..sources.shared import bounded_batches
from .projections import projected, with_projections

RATE = 22_050


def clips(spark: SparkSession, d: str) -> DataFrame:
    """(path, mtime, content): for every embedding a tone, hit or noise as WAVE bytes, by its label."""

    def render(batches):
        for b in (whole[at : at + 256] for whole in batches for at in range(0, len(whole), 256)):
            out = []
            for i, label in zip(b["file_id"], b["label"], strict=True):
                t = np.arange(int(RATE * (0.15 + 0.05 * (label % 10)))) / RATE
                tone = np.sin(2 * np.pi * (60 + 40 * label) * t)
                noise = np.random.default_rng(int(i)).standard_normal(len(t))
                y = {0: tone, 1: tone * np.exp(-20 * t), 2: noise * np.exp(-30 * t)}[int(label) % 3]
                out.append(audio.encode_wav(0.8 * y / max(1e-9, np.abs(y).max()), RATE))
            yield pd.DataFrame({"path": [f"/Clips/{int(i)}.wav" for i in b["file_id"]], "mtime": 0.0, "content": out})

    rows = projected(spark, d, "lib_signal").select("file_id", F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"))
    return bounded_batches(rows).mapInPandas(render, "path string, mtime double, content binary")


def probe_duration(spark: SparkSession, d: str) -> DataFrame:
    return audio.with_durations(clips(spark, d)).select("path", F.round("duration", 4).alias("duration"))


def audio_features(spark: SparkSession, d: str) -> DataFrame:
    return audio.with_features(clips(spark, d)).select("path", "duration", "features.*")


def classify_audio(spark: SparkSession, d: str) -> DataFrame:
    """Names, header, features, heuristic verdict, fusion: the batch classifier end to end."""
    found = audio.with_features(clips(spark, d)).withColumn("kind", F.when(F.col("duration") <= 1.2, "one-shot").otherwise("unknown"))
    return scan.classify(found, recognisers.verdicts(found, "auto"), "auto").select("path", "kind", "category", F.array_join("instruments", ",").alias("instruments"), "confidence", "backend")


def clip_analysis(spark: SparkSession, d: str) -> DataFrame:
    return audio.analyse_clip(audio.with_features(clips(spark, d)))


#: A clip's length follows from its label.
ORACLES = {"probe_duration": with_projections(f"select '/Clips/' || file_id || '.wav' as path, round(floor({RATE} * (0.15::double + 0.05::double * (coalesce(label, 0) % 10))) / {RATE}, 4) as duration from lib_signal")}


def queries() -> dict:
    return {f.__name__: f for f in (probe_duration, audio_features, classify_audio, clip_analysis)}
