"""Helpers shared by the corpus operators: the shared folder, written tables, folds and models.

Every table written here goes to the folder that ``spark.checkpoint.dir`` names, which all
executors and the driver can reach.  Only in local mode (tests, notebooks) may that setting be
absent; then :func:`shared_dir` makes a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset, one temporary folder per process in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = "file://" + tempfile.mkdtemp(prefix="sampleyard-")
        spark.sparkContext.setCheckpointDir(_FALLBACK["dir"])
    return _FALLBACK["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, *aggregates: Column) -> tuple[DataFrame, Row]:
    """:func:`written`, and ``aggregates`` of its rows, observed while they are written: no job of its own reads the table for them.

    Every job keeps plans, broadcasts and listings in the driver; what a written table needs to know of itself is not worth one.
    """
    seen = Observation()
    table = written(df.observe(seen, *aggregates), name)
    return table, Row(**seen.get)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def is_fold(doc_id: Column, parts: int, held: int) -> Column:
    """True where the row belongs to fold ``held``; a null id never does."""
    return F.coalesce(fold(doc_id, parts) == held, F.lit(False))


def digested(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with the hash and size of a text as ``__hash`` and ``__bytes``: what :func:`bounded_sample` needs.

    Made before texts are joined with labels, they let the counting pass leave the texts where they lie.
    """
    return rows.withColumn("__hash", F.xxhash64(text_col, F.lit("sample"))).withColumn("__bytes", F.octet_length(text_col))


def bounded_sample(labelled: DataFrame, text_col: str, label_col: str, limit: int, limit_bytes: int) -> DataFrame:
    """(text, y): distinct rows with a label, about ``limit`` of them and ``limit_bytes`` bytes of text at most.

    Rows are chosen by a hash of the text against a threshold from one aggregate over hashes, so that equal
    rows, however many, count once.  Nothing is sorted and no task sees all rows; while there are few, all stay.
    """
    rows = (labelled if "__hash" in labelled.columns else digested(labelled, text_col)).where(F.col(label_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"), "__hash", "__bytes")
    kinds = rows.groupBy("__hash", "y").agg(F.max("__bytes").alias("n"))
    found = kinds.agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("double")).alias("bytes")).first()
    share = min(1.0, limit / max(found["rows"], 1), limit_bytes / max(found["bytes"] or 0, 1))
    if share < 1:
        rows = rows.where(F.pmod("__hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    return rows.select("text", "y").dropDuplicates()


#: Keys that hold over one row in so many are joined by broadcast; there are at most so many of them.
HOT = 1000


def join_totals(rows: DataFrame, totals: DataFrame, key: str | list[str], total: int, count: str = "n") -> DataFrame:
    """``rows`` joined with ``totals``, one row for each key with its ``count`` of rows, where few keys may hold most of the ``total`` rows.

    Keys with over ``total / HOT`` rows, at most ``HOT``, are met by broadcast where their rows lie; the
    others, none of which is large, by an ordinary join.  ``count`` is not returned.  Of ``HOT`` rows or fewer none
    are many: they are joined as they are.
    """
    if total <= HOT:
        return rows.join(totals.drop(count), key)
    hot = totals.where(F.col(count) > total / HOT)
    known = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(*[key] if isinstance(key, str) else key)), key, "left_anti").join(totals, key)
    return known.unionByName(rest).drop(count)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits (wraps on overflow)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of a batch's column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def bounded_batches(df: DataFrame, rows: int = 1024, size: str = "8m") -> DataFrame:
    """``df``, after setting the session's Arrow batches to ``rows`` rows and ``size`` bytes, where they had more rows.

    A batch is held by the JVM and by the Python worker at once, and by several tasks of an executor; with
    long texts the default of 10,000 rows or 64 MB is a large part of an executor's memory.
    """
    conf, most, byte = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(most)) <= rows:
        conf.set(most, str(rows))
        conf.set(byte, size)
    return df


def slices(batch: pa.RecordBatch, rows: int) -> list[pa.RecordBatch]:
    """Zero-copy slices of at most ``rows`` rows, so that what a task holds at once stays small."""
    return [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)]


def spread_sql_conf(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
