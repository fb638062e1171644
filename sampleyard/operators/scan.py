"""Progressive scans: cached rows stay, others are classified, doubtful ones go to a second backend.

Everything is one plan over (path, mtime, ...): a left join decides what is cached, the first
tier's result is written once (by the caller's catalog commit or ``written``) and split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fusion, names, rules
from ..sources.errors import BadInputError
from ..sources.shared import checkpointed
from . import catalog

Classifier = Callable[[DataFrame], DataFrame]
#: Where files carry the name pass' STRUCT already (``path_names.with_names``).
NAME = "__name"


def classify(files: DataFrame, verdicts: Column | None, backend: str) -> DataFrame:
    """Tag columns of ``files(path, duration, mtime, ...)``: name pass, kind, verdicts merged and fused.

    ``verdicts`` is an ARRAY of verdict STRUCTs in run order (null: names only).  Row-local: no shuffle.  A column
    :data:`NAME` of ``files`` saves the name pass.
    """
    verdict = "struct<category:string,instruments:array<string>,source:string,confidence:double,caption:string,genres:" + fusion.GENRE_TYPE + ">"
    merged = F.lit(None).cast(verdict) if verdicts is None else fusion.merge(verdicts)
    # a generator computes name and verdict once for all of their fields
    name = [] if NAME in files.columns else [names.classify_name(F.col("path")).alias(NAME)]
    named = files.select("*", F.inline(F.array(F.struct(*name, merged.alias("__verdict")))))
    kind = rules.resolve_kind(F.col("__name")["kind"], F.col("__name")["category"], F.col("__name")["bpm"], F.col("duration"))
    return named.select(*fusion.fuse(F.col("path"), kind, F.col("duration"), F.col("__name"), F.col("__verdict"), backend), "mtime")


def scan_status(files: DataFrame, tags: DataFrame, primary: str, second: str | None = None, rescan: bool = False, carry: dict[str, str] | None = None) -> DataFrame:
    """``files`` with ``status``: cached, classify or escalate; ``carry`` names columns of ``tags`` that come along, and what to call them.

    A cached row that nobody edited, still from the primary backend and doubtful, goes straight to
    the second tier.
    """
    accept = [primary] if second is None else [primary, second]
    also = {"category": "__category", "instruments": "__instruments", "edited": "__was_edited"}
    found = catalog.fresh(files, tags, accept, rescan, {**{c: name for c, name in also.items() if c not in (carry or {})}, **(carry or {})})
    for c, name in (carry or {}).items():
        if c in also:
            found = found.withColumn(also[c], F.col(name))
    doubtful = rules.needs_escalation(F.col("__instruments"), F.col("__category"), F.col("path"), F.lit(None).cast("string")) & (F.col("cached_backend") == primary) & ~F.coalesce("__was_edited", F.lit(False))
    again = F.lit(second is not None) & F.coalesce(doubtful, F.lit(False))
    status = F.when(F.col("cached") & again, "escalate").when(F.col("cached"), "cached").otherwise("classify")
    return found.withColumn("status", status).drop("__category", "__instruments", "__was_edited", "cached", "cached_backend")


class ScanCounts:
    """Counts of a scan, observed while its rows are written; they are there once the scan's tables were kept."""

    def __init__(self) -> None:
        self.seen, self.made = Observation(), Observation()
        self.two_tiers = False

    def get(self) -> dict[str, int]:
        """Files classified, cached and escalated.  Waits for the writes, runs nothing."""
        seen = self.seen.get
        more = self.made.get["lost"] if self.two_tiers else 0
        return {"classified": seen["classified"], "cached": seen["cached"], "escalated": seen["escalated"] + more}


def progressive(
    files: DataFrame, tags: DataFrame, first: Classifier, second: Classifier | None = None, primary: str = "auto", second_name: str | None = None, rescan: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None, counts: ScanCounts | None = None, carry: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(tag rows to store, all files with status).

    ``keep`` persists the statuses, and the first tier's rows, before they are used twice (a table
    write or ``persist``).  Rows the first tier cannot place are not among its rows to store.  ``counts`` is
    filled by the writes that ``keep`` does.  Where the first tier's rows have all columns of the files, the
    second tier gets its files from them; else they are joined back.
    """
    status = scan_status(files, tags, primary, second_name if second else None, rescan, carry)
    is_status = lambda s: F.count_if(F.col("status") == s)
    if counts:
        counts.two_tiers = second is not None
        status = status.observe(counts.seen, is_status("classify").alias("classified"), is_status("cached").alias("cached"), is_status("escalate").alias("escalated"))
    status = keep(status) if keep else status
    one = first(status.where("status = 'classify'").select(files.columns))
    doubtful = rules.needs_escalation(F.col("instruments"), F.col("category"), F.col("path"), F.col("filename"))
    if second is not None:
        one = one.withColumn("__lost", doubtful)
        one = one.observe(counts.made, F.count_if("__lost").alias("lost")) if counts else one
    one = keep(one) if keep else one
    if second is None:
        return one, status
    if set(files.columns) <= set(one.columns):
        lost = one.where("__lost").select(files.columns)
    else:
        lost = status.where("status = 'classify'").join(one.where("__lost").select("path"), "path", "left_semi").select(files.columns)
    two = second(status.where("status = 'escalate'").select(files.columns).unionByName(lost))
    return one.where("NOT __lost").drop("__lost").unionByName(two), status


def summary(spark: SparkSession, counts: ScanCounts) -> DataFrame:
    """One row of a scan's counts."""
    return spark.createDataFrame([counts.get()], "classified long, cached long, escalated long")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``__rank``, their place from 0 on by ``order``, without a global sort in one task: ranges, positions within them, and the ranges' offsets."""
    spark = rows.sparkSession
    # checkpointed: range bounds come from a sample, so a second run of the shuffle could cut elsewhere
    cut = checkpointed(
        rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    offsets = cut.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return cut.join(F.broadcast(offsets), "__part").withColumn("__rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def length_batches(probes: DataFrame, size: int, key: str = "file_id") -> DataFrame:
    """Adds ``batch``: clips of like length together, ``size`` to a batch (unknown lengths count 0)."""
    rows = ranked(probes.withColumn("__length", F.coalesce("duration", F.lit(0.0))), ["__length", key])
    return rows.withColumn("batch", F.floor(F.col("__rank") / size)).drop("__length", "__rank")


def packed_batches(probes: DataFrame, seconds: float, size: int, key: str = "path") -> DataFrame:
    """Adds ``length``, what a clip is padded to, and ``batch``: clips of one length, at most ``size``, of ``seconds`` padded seconds at most.

    A clip longer than ``seconds`` is a batch by itself.  Unknown lengths count as the shortest.  Batches are numbered within a length.
    """
    if seconds <= 0 or size < 1:
        raise BadInputError("a batch has some seconds and one file at least")
    known = F.greatest(F.coalesce("duration", F.lit(1.0)), F.lit(1.0))
    step = F.ceil(F.log2(known) * 4 - 1e-9)  # classes are quarters of an octave
    rows = ranked(probes.withColumn("__class", step.cast("int")).withColumn("__known", known), ["__class", "__known", key])
    first = rows.groupBy("__class").agg(F.min("__rank").alias("__first"))  # a row for each class, of which lengths have few
    length = F.pow(F.lit(2.0), F.col("__class") / 4)
    most = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(float(seconds)) / length + 1e-9)))
    placed = rows.join(F.broadcast(first), "__class").withColumn("length", length).withColumn("batch", F.floor((F.col("__rank") - F.col("__first")) / most))
    return placed.drop("__class", "__known", "__rank", "__first")


def import_blobs(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """New blobs of ``uploads(content, name)``: (digest, ext, content), one for each digest and suffix not yet ``stored``."""
    return addressed(uploads).select("digest", "ext", "content").dropDuplicates(["digest", "ext"]).join(stored.select("digest", "ext"), ["digest", "ext"], "left_anti")


def addressed(uploads: DataFrame) -> DataFrame:
    """``uploads(content, name)`` with digest and suffix of their content's address, and the bare file name."""
    name = F.coalesce("name", F.lit(""))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return uploads.select(F.sha1("content").alias("digest"), F.when(suffix == "", ".wav").otherwise(suffix).alias("ext"), "content", F.element_at(F.split(name, "/"), -1).alias("filename"))


_SIGNS = "!$%()*+,:;<=>?@^"


def imported(uploads: DataFrame, folder: str, classifier: Classifier) -> DataFrame:
    """Tag rows of ``uploads(content, name)`` under their address in ``folder``, one for each address (the last name counts).

    ``classifier`` gets (path, mtime, content); as the path's last part is the upload's own name and the
    part before it the digest in signs that no rule reads, the name tells what the sound is.
    """
    one = addressed(uploads).groupBy("digest", "ext").agg(F.max("filename").alias("filename"), F.first("content").alias("content"))
    hidden = F.translate("digest", "0123456789abcdef", _SIGNS)
    made = classifier(one.select(F.concat(hidden, F.lit("/"), "filename").alias("path"), F.lit(0.0).alias("mtime"), "content"))
    digest, name = F.translate(F.split("path", "/", 2)[0], _SIGNS, "0123456789abcdef"), F.split("path", "/", 2)[1]
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return made.withColumn("filename", name).withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), digest, F.when(suffix == "", ".wav").otherwise(suffix)))
