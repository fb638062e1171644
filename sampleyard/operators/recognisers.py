"""Recognisers: named plan builders that add a verdict STRUCT per file, and their selection.

A model backend is a function from DataFrame to DataFrame: it adds an ``embedding`` or a
``caption`` column (by an Arrow UDF that loads its model once per worker); scoring is expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import captions, rules, similarity
from ..functions import taxonomy as T
from ..sources import config
from ..sources.errors import BackendError, BadInputError
from . import scan

VERDICT = "struct<category:string,instruments:array<string>,source:string,confidence:double,caption:string,genres:array<struct<genre:string,score:double,source:string>>>"
Captioner = Callable[[list[str]], list[str | None]]

_BUILDERS: dict[str, Callable[[DataFrame], Column]] = {}
#: The column that a model's output is in; without it a recogniser has nothing to go by.
_NEEDS: dict[str, str] = {}


def register(name: str, verdict: Callable[[DataFrame], Column], needs: str | None = None) -> None:
    """Make a recogniser known: ``verdict(df)`` is its STRUCT over columns of ``df``, of which it needs one."""
    _BUILDERS[name] = verdict
    if needs:
        _NEEDS[name] = needs


def register_embeddings(categories: dict[str, list[list[float]]], instruments: list[list[float]], genres: list[list[float]]) -> None:
    """Make ``clap`` known: scores of the column ``embedding`` against a model's label embeddings (by kind; instruments; genres)."""
    register("clap", lambda df: similarity.recognise_embedding(F.col("embedding"), F.col("kind"), categories, instruments, genres), needs="embedding")


def backends() -> list[str]:
    return sorted(_BUILDERS)


def recogniser(name: str) -> Callable[[DataFrame], Column]:
    if name not in _BUILDERS:
        raise BadInputError(f"unknown backend {name!r}; known: {', '.join(backends())}")
    return _BUILDERS[name]


def select(spec: str, columns: list[str]) -> list[str]:
    """``auto``: of the known recognisers, in run order, those whose model's column is there, and the heuristic; else the one named."""
    if spec != "auto":
        recogniser(spec)
        if _NEEDS.get(spec, spec) not in [*columns, spec]:
            raise BackendError(f"backend {spec!r} needs a column {_NEEDS[spec]!r}")
        return [spec]
    return [n for n in T.RUN_ORDER if n in _BUILDERS and (n not in _NEEDS or _NEEDS[n] in columns)]


def verdicts(df: DataFrame, spec: str) -> Column:
    """ARRAY of the selected backends' verdicts in run order."""
    return F.array(*[recogniser(n)(df).cast(VERDICT) for n in select(spec, df.columns)])


def batch_size() -> int:
    """Files to a model call: the setting ``captioner.batch``, at least 1; 8 where it is no number."""
    try:
        return max(1, int(config.effective()["captioner.batch"]))
    except ValueError:
        return 8


def said_of(model: Captioner, paths: list[str]) -> list[str | None]:
    """A caption for each path by one model call; where it fails, of either half by itself, and null where a single file does."""
    try:
        said = list(model(paths))
        if len(said) != len(paths):
            raise BackendError(f"{len(said)} captions of {len(paths)} files")
        return said
    except Exception:  # noqa: BLE001 - a model may fail in any way
        if len(paths) == 1:
            return [None]
        half = len(paths) // 2
        return said_of(model, paths[:half]) + said_of(model, paths[half:])


def with_captions(files: DataFrame, captioner: Callable[[], Captioner], batch: int | None = None, sink: Callable[[str, str | None], None] | None = None, seconds: float = 240.0, counts: Observation | None = None) -> DataFrame:
    """Adds ``caption`` to ``files(path, ...)``: model calls in batches (by default of the setting's size), by halves where a batch fails, null where a file does.

    Where the files have a ``duration``, a batch holds clips of like length from all over the table, and ``seconds`` padded
    seconds at most; else files as they come.  ``captioner`` makes the model, once per task; ``sink`` is told each
    result and may fail.  ``counts`` is filled by whatever writes the result: :func:`run_record` makes a record of it.
    """
    batch = batch_size() if batch is None else batch
    if batch < 1:
        raise BackendError("a batch has at least one file")
    if "caption" in files.columns:
        raise BadInputError("the files have captions already")
    columns = files.columns
    packs = "duration" in columns
    rows = files
    if packs:
        packed = scan.packed_batches(files, seconds, batch)
        pack = F.struct((-F.col("length")).alias("length"), "batch")  # the longest first: a task does not end on them
        rows = packed.select(*columns, pack.alias("__pack")).repartition("__pack").sortWithinPartitions("__pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = time.perf_counter()
        model = captioner()
        load = [time.perf_counter() - began]  # told once, by the first row

        def answered(part: pa.RecordBatch) -> pa.RecordBatch:
            paths = part.column(columns.index("path")).to_pylist()
            began = time.perf_counter()
            out = said_of(model, paths)
            took = time.perf_counter() - began
            for p, c in zip(paths, out, strict=True) if sink else ():
                try:
                    sink(p, c)
                except Exception:  # noqa: BLE001, S110 - progress must not stop the work
                    pass
            only_first = lambda x: pa.array([x, *[0.0] * (len(paths) - 1)], pa.float64())
            spent = [only_first(took), only_first(load.pop() if load else 0.0), only_first(1.0)]
            return pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(out, pa.string()), *spent], names=[*columns, "caption", *_SPENT])

        waiting: list[pa.RecordBatch] = []  # of one pack, which may go on in the next Arrow batch
        for b in batches:
            keys = b.column(len(columns)).to_pylist() if packs else [at // batch for at in range(b.num_rows)]
            starts = [at for at in range(b.num_rows) if at == 0 or keys[at] != keys[at - 1]]
            for at, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                part = b.slice(at, end - at)
                if waiting and (not packs or waiting[0].column(len(columns))[0].as_py() != keys[at]):
                    yield answered(_one(waiting))
                    waiting = []
                waiting.append(part)
        if waiting:
            yield answered(_one(waiting))

    made = rows.mapInArrow(run, StructType([*files.schema.fields, StructField("caption", StringType()), *(StructField(c, DoubleType()) for c in _SPENT)]))
    if counts:
        took, load, calls = (F.coalesce(F.sum(c), F.lit(0.0)) for c in _SPENT)
        made = made.observe(counts, F.count("*").alias("files"), F.count("caption").alias("captioned"), calls.cast("long").alias("batches"), took.alias("seconds"), load.alias("load_seconds"))
    return made.drop(*_SPENT)


#: Columns in which a batch's first row says what it took; they do not leave this module.
_SPENT = ["__seconds", "__load_seconds", "__calls"]


def run_record(spark: SparkSession, counts: Observation) -> DataFrame:
    """One row for the analytics of a captioner's run: files, captioned, failed, batches, seconds of captioning and of loading, and loading's share."""
    c = counts.get
    whole = c["seconds"] + c["load_seconds"]
    row = ("captions", c["files"], c["captioned"], c["files"] - c["captioned"], c["batches"], c["seconds"], c["load_seconds"], c["load_seconds"] / whole if whole else 0.0)
    return spark.createDataFrame([row], "event string, files long, captioned long, failed long, batches long, seconds double, load_seconds double, load_share double")


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def loop_context(df: DataFrame, verdict: str, caption_again: str) -> Column:
    """The verdict column, or what the sound's caption as a loop says where the first was doubtful."""
    again = captions.recognise_caption(F.col(caption_again), F.lit("one-shot"))
    doubtful = rules.loop_context_candidate(F.col("kind"), F.col("duration"), F.col(verdict)["category"], F.col("features")["voiced_ratio"])
    return F.when(doubtful & again.isNotNull(), rules.loop_context_override(F.col(verdict), again)).otherwise(F.col(verdict))


register("ace-step", lambda df: captions.recognise_caption(F.col("caption"), F.col("kind")), needs="caption")
register("heuristic", lambda df: rules.recognise_features(F.col("features"), F.col("kind")))
