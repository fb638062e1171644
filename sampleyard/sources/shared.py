"""Lineage cuts in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a folder of its own only where none is named, in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sampleyard-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew where it lies in fewer partitions than there are cores: for rows that cost far more to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded_batches(df: DataFrame, rows: int = 1024, size: str = "8m") -> DataFrame:
    """``df``, after setting the session's Arrow batches to ``rows`` rows and ``size`` bytes, where they had more rows.

    Rows that hold whole files or signals lie in the JVM and in Python workers a batch at a time, for each task of an executor.
    """
    conf, most = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(most)) <= rows:
        conf.set(most, str(rows))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df
