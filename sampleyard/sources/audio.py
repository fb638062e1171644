"""Audio files as DataFrames: listing, header durations, decoding and features.

Listing never reads content.  For features a file is decoded once, in the task that has its row; a row of numbers for each frame
leaves that task, samples and spectra do not, and the features are windows and aggregates over these rows
(:mod:`sampleyard.operators.frames`); an unreadable file gives null.  The signal methods
follow public definitions (short-time spectra, YIN pitch, median-filter separation); they
approximate, not reproduce, any particular library.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy as T
from ..functions.names import file_name
from ..operators import frames
from . import config
from .shared import bounded_batches, checkpointed, dealt

FEATURES = [
    "spectral_centroid", "spectral_rolloff", "zero_crossing_rate", "log_attack_time", "percussive_ratio",
    "voiced_ratio", "pitch_stability", "transient_density", "formant_strength", "tempo",
]
FEATURES_DDL = ", ".join(f"{f} double" for f in FEATURES) + ", chroma array<double>"
FRAME, HOP = 2048, 512
#: Pitch is tracked at this rate whatever the file's own (a constant scale that drops out of the stability).
PITCH_RATE = 22_050.0


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length) of the audio files below a folder, in path order by components; content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    name = file_name(F.col("path"))
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kept = found.where(suffix.isin(T.AUDIO_SUFFIXES) & ~name.startswith("._"))
    return kept.select("path", F.col("modificationTime").cast("double").alias("mtime"), "length").orderBy(F.split("path", "/"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, content) of the audio files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.where(suffix.isin(T.AUDIO_SUFFIXES) & ~file_name(F.col("path")).startswith("._")).select("path", F.col("modificationTime").cast("double").alias("mtime"), "content")


def load(files: DataFrame) -> DataFrame:
    """``files(path, mtime)`` with ``content``, each file read in the task that has its row; files that cannot be read are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, mtime in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with _opened(path) as f:
                        content = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([mtime], pa.float64()), pa.array([content], pa.binary())], names=["path", "mtime", "content"])

    return files.select("path", "mtime").mapInArrow(run, "path string, mtime double, content binary")


def _opened(path: str) -> pa.NativeFile:
    """A file of any file system that pyarrow knows; Spark writes local ones as ``file:/...``."""
    local = re.match(r"file:/+", path)
    fs, own = (pafs.LocalFileSystem(), "/" + path[local.end() :]) if local else (pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path))
    return fs.open_input_file(own)


def uploads(rows: DataFrame) -> DataFrame:
    """``rows(content, name_hint, position)`` as files: the name is the hint or ``upload-<position>.wav``."""
    return rows.select(F.coalesce("name_hint", F.concat(F.lit("upload-"), F.col("position").cast("string"), F.lit(".wav"))).alias("path"), F.lit(None).cast("double").alias("mtime"), "content")


def write_blobs(blobs: DataFrame, folder: str) -> int:
    """Write ``blobs(digest, ext, content)`` as ``<folder>/<digest><ext>`` where there is no such file yet; how many were written.

    A file appears under its name only when whole, so a task that runs again does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        for b in batches:
            made = 0
            for digest, ext, content in zip(*(b.column(c).to_pylist() for c in ("digest", "ext", "content")), strict=True):
                path = f"{root}/{digest}{ext}"
                if fs.get_file_info(path).type == pafs.FileType.NotFound:
                    partial = f"{path}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(partial) as out:
                        out.write(content or b"")
                    fs.move(partial, path)
                    made += 1
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["made"])

    return blobs.select("digest", "ext", "content").mapInArrow(write, "made long").agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]


def append_analytics(records: DataFrame, folder: str | None = None) -> bool:
    """Append one JSON line for each row, stamped ``ts``, to ``folder`` (by default the setting ``captioner.analytics``); nothing where that is empty."""
    folder = folder or config.effective()["captioner.analytics"]
    if not folder:
        return False
    records.select(F.round(F.unix_micros(F.current_timestamp()) / 1e6, 3).alias("ts"), "*").write.mode("append").json(folder)
    return True


# --- containers ----------------------------------------------------------------------------------


def _riff(data: bytes) -> tuple[int, int, int, int, int, int] | None:
    """(format, channels, rate, bits, offset, bytes) of the sound data of a RIFF/WAVE file."""
    at, form = 12, None
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if tag == b"fmt " and at + 24 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack("<H", data[at + 32 : at + 34])[0]
            form = (kind, channels, rate, bits)
        elif tag == b"data" and form:
            return (*form, at + 8, size)
        at += 8 + size + size % 2
    return None


def _extended(raw: bytes) -> float:
    """An 80-bit float, as AIFF keeps its rate."""
    exponent, mantissa = struct.unpack(">HQ", raw)
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def _aiff(data: bytes) -> tuple[int, float, int, int, int, int] | None:
    """(channels, rate, bits, frames, offset, bytes) of an AIFF file."""
    at, form, sound = 12, None, (0, 0)
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        if tag == b"COMM" and at + 26 <= len(data):
            channels, frames, bits = struct.unpack(">hIh", data[at + 8 : at + 16])
            form = (channels, _extended(data[at + 16 : at + 26]), bits, frames)
        elif tag == b"SSND":
            sound = (at + 16, size - 8)
        at += 8 + size + size % 2
    return (*form, *sound) if form else None


class Ranged:
    """Reads parts of a file of ``size`` bytes by ``read(at, count)``, and counts what it read."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self._read, self.size, self.bytes = read, size, 0

    def at(self, start: int, count: int) -> bytes:
        got = self._read(start, count) if start < self.size else b""
        self.bytes += len(got)
        return got


#: Bytes looked at behind a header: for the first frame of mp3 data and for the last page of ogg data.
_SPAN = 1 << 16
# Fixed values of MPEG audio headers: kbit/s of version 1 and 2 for layers 1 to 3, hertz by version, samples a frame.
_KBITS = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_MPEG_RATES = {3: [44_100, 48_000, 32_000], 2: [22_050, 24_000, 16_000], 0: [11_025, 12_000, 8_000]}
_FRAME_SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


def _chunks(f: Ranged, order: str) -> Iterator[tuple[bytes, int, int]]:
    """(tag, place of the body, its size) of the chunks of a RIFF or AIFF file; bodies are passed over."""
    at = 12
    while len(head := f.at(at, 8)) == 8:
        size = struct.unpack(f"{order}I", head[4:])[0]
        yield head[:4], at + 8, size
        at += 8 + size + size % 2


def _wave_seconds(f: Ranged) -> float | None:
    width = rate = 0
    for tag, at, size in _chunks(f, "<"):
        if tag == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.at(at, 16))
            width = channels * ((bits + 7) // 8)
        elif tag == b"data" and width and rate:
            return size / width / rate
    return None


def _aiff_seconds(f: Ranged) -> float | None:
    for tag, at, _ in _chunks(f, ">"):
        if tag == b"COMM":
            body = f.at(at, 18)
            rate = _extended(body[8:18])
            return struct.unpack(">I", body[2:6])[0] / rate if rate else None
    return None


def _flac_seconds(f: Ranged) -> float | None:
    packed = int.from_bytes(f.at(18, 8), "big")
    rate, frames = packed >> 44, packed & ((1 << 36) - 1)
    return frames / rate if rate else None


def _ogg_seconds(f: Ranged) -> float | None:
    """The position that the last page says, over the rate of the first page's header."""
    head, tail = f.at(0, 128), f.at(max(0, f.size - _SPAN), _SPAN)
    last = tail.rfind(b"OggS")
    place = struct.unpack("<q", tail[last + 6 : last + 14])[0] if last >= 0 else -1
    if place < 0:
        return None
    if (at := head.find(b"\x01vorbis")) >= 0:
        rate = struct.unpack("<I", head[at + 12 : at + 16])[0]
        return place / rate if rate else None
    if (at := head.find(b"OpusHead")) >= 0:  # always 48,000, after what is to be skipped
        return max(0, place - struct.unpack("<H", head[at + 10 : at + 12])[0]) / 48_000
    return None


def _mpeg_header(raw: bytes) -> tuple[int, int, int, int, int] | None:
    """(version 1 or 2, layer, bits a second, rate, samples a frame) of a frame's four bytes."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, step, rate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or step in (0, 15) or rate == 3:
        return None
    kind = (1 if version == 3 else 2, layer)
    return (*kind, 1000 * _KBITS[kind][step - 1], _MPEG_RATES[version][rate], _FRAME_SAMPLES[kind])


def _mpeg_seconds(f: Ranged) -> float | None:
    """By the frame count of a Xing, Info or VBRI header in the first frame, else by its bit rate."""
    tag = f.at(0, 10)
    start = 10 + sum((b & 0x7F) << 7 * k for k, b in enumerate(reversed(tag[6:10]))) if tag[:3] == b"ID3" else 0
    data = f.at(start, _SPAN)
    for at in (m.start() for m in re.finditer(b"\xff[\xe2-\xff]", data)):
        found = _mpeg_header(data[at : at + 4])
        if not found:
            continue
        _, layer, bits, rate, samples = found
        size = (12 * bits // rate) * 4 if layer == 1 else samples // 8 * bits // rate  # without padding
        if at + size + 1 < len(data) and not any(_mpeg_header(data[at + size + pad : at + size + pad + 4]) for pad in (0, 1, 4)):
            continue  # no frame follows: not a frame's beginning
        frame = data[at : at + 192]
        for mark in (b"Xing", b"Info"):
            if (k := frame.find(mark)) >= 0 and frame[k + 7] & 1:
                return struct.unpack(">I", frame[k + 8 : k + 12])[0] * samples / rate
        if (k := frame.find(b"VBRI")) >= 0:
            return struct.unpack(">I", frame[k + 14 : k + 18])[0] * samples / rate
        return (f.size - start - at) * 8 / bits
    return None


def seconds_of(f: Ranged) -> float | None:
    """Seconds by the headers of WAVE, AIFF, FLAC, ogg (vorbis, opus) or mp3 data; None where there is no rate or another format."""
    try:
        head = f.at(0, 12)
        if head[:4] == b"RIFF" and head[8:] == b"WAVE":
            return _wave_seconds(f)
        if head[:4] == b"FORM" and head[8:] in (b"AIFF", b"AIFC"):
            return _aiff_seconds(f)
        if head[:4] == b"fLaC":
            return _flac_seconds(f)
        if head[:4] == b"OggS":
            return _ogg_seconds(f)
        return _mpeg_seconds(f) if head[:3] == b"ID3" or _mpeg_header(head[:4]) else None
    except (struct.error, ZeroDivisionError, IndexError, OverflowError):
        return None


def duration(data: bytes) -> float | None:
    """:func:`seconds_of` a file's whole contents."""
    return seconds_of(Ranged(lambda at, count: data[at : at + count], len(data)))


def decode(data: bytes) -> tuple[np.ndarray, float] | None:
    """(mono signal, rate) of PCM WAVE or AIFF data, else None."""
    try:
        if data[:4] == b"RIFF" and (w := _riff(data)):
            kind, channels, rate, bits, at, size = w
            order = "<"
        elif data[:4] == b"FORM" and (a := _aiff(data)):
            channels, rate, bits, _, at, size = a
            kind, order = 1, ">"
        else:
            return None
        raw = data[at : at + size]
        if kind == 3:
            y = np.frombuffer(raw[: len(raw) // (bits // 8) * (bits // 8)], f"{order}f{bits // 8}").astype(np.float64)
        elif bits == 8:
            y = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128 if order == "<" else np.frombuffer(raw, np.int8) / 128
        elif bits == 24:
            b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
            b = b if order == "<" else b[:, ::-1]
            y = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float64) - 0x800000
            y = y / 0x800000
        else:
            width = bits // 8
            y = np.frombuffer(raw[: len(raw) // width * width], f"{order}i{width}").astype(np.float64) / (1 << (bits - 1))
        y = y[: len(y) // channels * channels].reshape(-1, channels).mean(axis=1)
        return (y, float(rate)) if rate else None
    except (struct.error, ValueError, TypeError, ZeroDivisionError):
        return None


def encode_wav(y: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAVE data."""
    pcm = (np.clip(y, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


# --- features ------------------------------------------------------------------------------------


def pitches(frames: np.ndarray) -> np.ndarray:
    """YIN pitch of each frame between C2 and C7, NaN where there is none."""
    low, high = int(PITCH_RATE / 2093.0), min(FRAME // 2 - 1, int(PITCH_RATE / 65.4))
    spectrum = np.fft.rfft(frames, 2 * FRAME, axis=1)
    correlation = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, : high + 1]
    power = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    lags = np.arange(high + 1)
    difference = power[:, FRAME - lags] + power[:, FRAME, None] - power[:, lags] - 2 * correlation
    mean = difference[:, 1:] * np.arange(1, high + 1) / np.maximum(np.cumsum(difference[:, 1:], axis=1), 1e-12)
    under = mean[:, low - 1 :] < 0.15
    first = under.argmax(axis=1) + low - 1
    # from the first lag that is low enough down to where the curve rises again
    rising = np.concatenate([mean[:, 1:] >= mean[:, :-1], np.ones((len(frames), 1), bool)], axis=1)
    at = (rising & (np.arange(high) >= first[:, None])).argmax(axis=1)
    return np.where(under.any(axis=1) & (np.abs(frames).max(axis=1) >= 1e-6), PITCH_RATE / (at + 1), np.nan)


#: What :func:`_rows_of` gives of a clip (its first row, without a frame) and of each of its frames.
_CLIP = {"rate": "double", "seconds": "double", "zero_crossing_rate": "double", "log_attack_time": "double"}
_FRAME = {"frame": "long", "rise": "double", "p": "double", "h": "double", "centroid": "double", "rolloff": "double", "pitch": "double", "chroma": "array<double>", "spreads": "array<double>"}
_ROWS = _CLIP | _FRAME
_ROWS_DDL = ", ".join(f"{c} {t}" for c, t in _ROWS.items())


def waveform(y: np.ndarray, rate: float) -> dict[str, float]:
    sign = np.signbit(y)
    crossings = float((sign[1:] != sign[:-1]).sum() / len(y)) if len(y) else 0.0
    attack = float(np.log10(max(int(np.abs(y).argmax()) / rate, 1e-4))) if len(y) else -3.0
    return {"rate": rate, "seconds": len(y) / rate, "zero_crossing_rate": crossings, "log_attack_time": attack}


def _table(values: dict, n: int, types: dict[str, str]) -> list[pa.Array]:
    """Columns of ``n`` rows in the order of ``types``, null where there is no value; NaN is null too."""
    out = []
    for c, t in types.items():
        x, kind = values.get(c), pa.int64() if t == "long" else pa.float64()
        if x is None:
            out.append(pa.nulls(n, pa.list_(kind) if t.startswith("array") else kind))
        elif t.startswith("array"):
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind)))
        else:
            out.append(pa.array(np.atleast_1d(x), kind, from_pandas=True))
    return out


def _rows_of(clip: pa.Array, y: np.ndarray | None, rate: float | None, more: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """A row of the clip, with ``more`` columns before those of ``_ROWS``, and a row for each frame, where they are null."""
    names = ["clip", *(f"more{k}" for k in range(len(more))), *_ROWS]
    own = waveform(y, rate) if y is not None else {}
    yield pa.RecordBatch.from_arrays([clip, *more, *_table(own, 1, _ROWS)], names=names)
    for found in frames.frame_rows(y, rate / FRAME, FRAME, HOP, pitches) if y is not None and len(y) else ():
        n = len(found["frame"])
        yield pa.RecordBatch.from_arrays([clip.take(pa.array([0] * n)), *(pa.nulls(n, x.type) for x in more), *_table(found, n, _ROWS)], names=names)


def _packed(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _features(rows: DataFrame) -> DataFrame:
    """(clip, features STRUCT) of ``rows(clip, <_ROWS>)``, a written table."""
    clips, by_frame = rows.where(F.col("frame").isNull()).select("clip", *_CLIP).where(F.col("rate").isNotNull()), rows.where(F.col("frame").isNotNull())
    rises = by_frame.where(F.col("frame") > 0).select("clip", "frame", "rise")
    peaks = frames.onsets(rises).groupBy("clip").agg(F.count_if("peak").alias("peaks"), F.max("rise").alias("top"))
    tempo = frames.tempos(rises.join(clips.select("clip", "rate"), "clip"), F.col("rate") / HOP)
    steady = F.when((F.count("pitch") > 1) & (F.avg("pitch") > 0), F.stddev_pop("pitch") / F.avg("pitch")).otherwise(1.0)
    energy = F.sum("p") + F.sum("h")
    bands = F.array_compact(F.array(*[F.var_pop(F.get("spreads", F.lit(k))) for k in range(frames.BANDS)]))
    # the frames of a clip lie together: a clip's sums are nearly all made where they are
    sums = by_frame.groupBy("clip").agg(
        F.avg("centroid").alias("spectral_centroid"), F.avg("rolloff").alias("spectral_rolloff"), F.when(energy > 0, F.sum("p") / energy).alias("percussive_ratio"),
        (F.count("pitch") / F.count("*")).alias("voiced_ratio"), steady.alias("pitch_stability"), bands.alias("bands"), F.array(*[F.avg(F.get("chroma", F.lit(k))) for k in range(12)]).alias("chroma"),
    )
    found = clips
    for part in (sums, peaks, tempo):  # one row a clip each
        found = found.join(part, "clip", "left")
    density = F.when((F.col("seconds") > 0) & (F.col("top") > 0), F.col("peaks") / F.col("seconds"))
    contrast = F.when(F.size("bands") > 0, F.aggregate("bands", F.lit(0.0), lambda a, v: a + v) / F.size("bands"))
    none = {"pitch_stability": 1.0}
    values = found.withColumn("transient_density", density).withColumn("formant_strength", contrast)
    made = [F.coalesce(F.col(f), F.lit(none.get(f, 0.0))).alias(f) for f in FEATURES]
    return values.select("clip", F.struct(*made, F.coalesce("chroma", F.array_repeat(F.lit(0.0), F.lit(12))).alias("chroma")).alias("features"))


def signal_features(signals: DataFrame) -> DataFrame:
    """(clip, features STRUCT) of ``signals(clip, rate, y)``, by rows of frames; an empty signal has its defined values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, rate in enumerate(b.column(1).to_pylist()):
                    yield from _rows_of(b.column(0).slice(at, 1), b.column(2).slice(at, 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), rate, [])

        return _packed(each())

    kind = signals.schema["clip"].dataType.simpleString()
    known = bounded_batches(dealt(signals.where(F.col("y").isNotNull()).select("clip", "rate", "y")))
    return _features(checkpointed(known.mapInArrow(run, f"clip {kind}, {_ROWS_DDL}")))


def with_features(files: DataFrame) -> DataFrame:
    """``files(path, mtime, content)`` -> (path, mtime, duration, features STRUCT); one decode per file, null features where there is no signal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(b.num_rows):
                    one = b.slice(at, 1)
                    raw = one.column(3)[0].as_py() or b""
                    y, rate = decode(raw) or (None, None)
                    yield from _rows_of(one.column(0), y, rate, [one.column(1), one.column(2), pa.array([duration(raw)], pa.float64())])

        return _packed(each())

    known = bounded_batches(dealt(files.select(F.monotonically_increasing_id().alias("clip"), "path", "mtime", "content")))
    kinds = f"clip long, more0 string, more1 double, more2 double, {_ROWS_DDL}"
    rows = checkpointed(known.mapInArrow(run, kinds).withColumnsRenamed({"more0": "path", "more1": "mtime", "more2": "duration"}))
    clips = rows.where(F.col("frame").isNull()).select("clip", "path", "mtime", "duration")
    return clips.join(_features(rows.select("clip", *_ROWS)), "clip", "left").drop("clip")


def with_durations(files: DataFrame) -> DataFrame:
    """``files(path, content)`` -> (path, duration), of contents that are in rows already, a bounded batch of them at a time; :func:`probed` reads headers alone."""

    @F.pandas_udf("double")
    def seconds(content: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else duration(x) for x in content], dtype="float64")

    return bounded_batches(files).select("path", seconds("content").alias("duration"))


def probed(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` -> (path, duration, bytes_read): headers read in the tasks by seeking, a bounded part of each file.

    Chunk heads of WAVE and AIFF, the first block of FLAC, the first and last page of ogg, the tag and first frame of
    mp3.  A file that cannot be opened has a null duration and 0 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seconds, counts = [], []
            for path in b.column(0).to_pylist():
                try:
                    with _opened(path) as f:
                        source = Ranged(lambda at, count, f=f: f.read_at(count, at), f.size())
                        seconds.append(seconds_of(source))
                        counts.append(source.bytes)
                except (OSError, TypeError):
                    seconds.append(None)
                    counts.append(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seconds, pa.float64()), pa.array(counts, pa.int64())], names=["path", "duration", "bytes_read"])

    return files.select("path").mapInArrow(run, "path string, duration double, bytes_read long")


def loop_render(files: DataFrame, bpm: float = T.LOOP_CONTEXT["bpm"], bars: int = T.LOOP_CONTEXT["bars"]) -> DataFrame:
    """``files(path, content)`` -> (path, content): each sound on every beat of ``bars`` bars, peak-normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                signal = decode(raw or b"")
                if signal is None:
                    out.append(None)
                    continue
                y, rate = signal
                step, beats = int(60.0 / bpm * rate), 4 * bars
                mixed = np.zeros(step * beats + len(y))
                for k in range(beats):
                    mixed[k * step : k * step + len(y)] += y
                top = np.abs(mixed).max(initial=0)
                out.append(encode_wav(mixed / top if top > 0 else mixed, int(rate)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


def analyse_clip(features: DataFrame) -> DataFrame:
    """(path, native_bpm, warp, source, key, scale): file-name cues first, then the signal."""
    from ..functions import names, rules, signal

    path, f = F.col("path"), F.col("features")
    warp, bpm = names.warp_from_filename(path), names.bpm_from_filename(path)
    key = signal.detect_key(f["chroma"])
    return features.select(
        "path",
        F.coalesce(bpm, F.round(f["tempo"], 2)).alias("native_bpm"),
        F.coalesce(warp, rules.warp_mode(f)).alias("warp"),
        F.when(warp.isNotNull(), "filename").otherwise("tempo_analysis").alias("source"),
        key["key"].alias("key"),
        key["scale"].alias("scale"),
    )
