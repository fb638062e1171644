"""New and changed files of a folder, classified as they arrive and merged into a catalog.

A listing is announced by appending it to a log; the stream over the log keeps (path, time) pairs it has seen as
state, so a file comes again when it was changed and not otherwise.  Each micro-batch passes the
catalog's freshness test first: edited rows stay as they are, and a stream begun anew classifies nothing twice.
The number of a batch is stored by the commit that has its rows, so a batch that runs again after a
failure makes no second commit.

What the first tier cannot place is handed on through files of their own, one folder for each batch; the second
tier is a stream over these, which may fail, lag or begin again without the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules
from ..functions import taxonomy as T
from ..functions.names import file_name
from ..operators import catalog as ops
from ..operators.scan import Classifier
from ..sources import audio
from ..sources.catalog import Catalog
from ..sources.shared import checkpointed

_LOG = "path string, mtime double, length long, seen_at timestamp"
_HANDED_ON = "path string, mtime double"


def follow(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, mtime, content) of audio files below ``root``; the file source finds each path once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.where(suffix.isin(T.AUDIO_SUFFIXES) & ~file_name(F.col("path")).startswith("._")).select("path", F.col("modificationTime").cast("double").alias("mtime"), "content")


def announce(listing: DataFrame, log: str) -> None:
    """Append a listing (path, mtime, length) to the folder ``log``."""
    listing.select("path", "mtime", "length").withColumn("seen_at", F.current_timestamp()).write.mode("append").parquet(log)


def changes(spark: SparkSession, log: str, horizon: str = "30 days", files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, mtime) that are new in the listings of ``log``.

    A pair is remembered for ``horizon``, which bounds the state; should it be announced later still, the
    catalog's freshness test meets it.
    """
    rows = spark.readStream.schema(_LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log)
    return rows.withWatermark("seen_at", horizon).dropDuplicatesWithinWatermark(["path", "mtime"]).select("path", "mtime")


def with_content(files: DataFrame) -> DataFrame:
    """``files(path, mtime)`` with ``content``, read where a file's row is; files that are gone are left out."""
    return audio.load(files)


def _run(files: DataFrame, store, checkpoint: str, once: bool) -> StreamingQuery:
    writer = files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _stamped(made: DataFrame) -> DataFrame:
    return made.withColumn("scanned_at", F.unix_micros(F.current_timestamp()) / 1e6)


def store_batch(batch: DataFrame, number: int, catalog: Catalog, classifier: Classifier, stream: str, accept: list[str], hand_on: str | None = None) -> bool:
    """Classify and commit one batch of a stream; whether there was something to commit that was not before.

    Rows that ``classifier`` cannot place go to ``<hand_on>/batch=<number>`` as well.
    """
    if catalog.streamed(stream) >= number:
        return False
    one = batch.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(F.struct(*batch.columns), F.coalesce("mtime", F.lit(float("-inf")))).alias("row")).select("row.*")
    stale = checkpointed(ops.fresh(one, catalog.tags, accept).where(~F.col("cached")).select(*batch.columns))
    if stale.isEmpty():
        return False
    made = checkpointed(_stamped(classifier(stale)))
    if hand_on:  # before the commit: a batch that stops between the two runs again and writes the same
        doubtful = rules.needs_escalation(F.col("instruments"), F.col("category"), F.col("path"), F.col("filename"))
        made.where(doubtful).select("path", F.col("mtime").cast("double").alias("mtime")).write.mode("overwrite").parquet(f"{hand_on}/batch={number}")
    catalog.upsert(made, stream=(stream, number))
    return True


def ingest(files: DataFrame, catalog: Catalog, first: Classifier, checkpoint: str, hand_on: str | None = None, primary: str = "auto", second: str | None = None, stream: str = "first", once: bool = True) -> StreamingQuery:
    """Classify each micro-batch of ``files(path, mtime, ...)`` and upsert it.

    ``primary`` and ``second`` name the backends whose rows count as fresh; ``stream`` names this stream in the catalog.
    """
    accept = [primary] if second is None else [primary, second]
    return _run(files, lambda batch, n: store_batch(batch, n, catalog, first, stream, accept, hand_on), checkpoint, once)


def escalate(spark: SparkSession, hand_on: str, catalog: Catalog, second: Classifier, checkpoint: str, second_name: str, stream: str = "second", once: bool = True) -> StreamingQuery:
    """The second tier: a stream of its own over what :func:`ingest` handed on.  Rows of ``second_name`` and edited ones are left alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(hand_on)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    rows = spark.readStream.schema(_HANDED_ON + ", batch long").option("pathGlobFilter", "*.parquet").parquet(hand_on).select("path", "mtime")
    return _run(rows, lambda batch, n: store_batch(batch, n, catalog, second, stream, [second_name]), checkpoint, once)


def event_counts(spark: SparkSession, folder: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Our own: counts of events by type in windows of event time, with a watermark for late ones."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
