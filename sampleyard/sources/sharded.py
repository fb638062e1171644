"""A catalog whose tags are a bucketed table that edits rewrite in part.

Tags lie in a Spark table partitioned by ``shard`` and bucketed by path (two different hashes of the path), with
bloom filters on path.  So a join on path needs no shuffle of the tags, a point read opens one bucket of one
shard, and an edit rewrites by dynamic partition overwrite the shards that hold its paths, and no other.  Posting
tables (:mod:`sampleyard.operators.postings`) are partitioned by the same shards and kept in step: a shard is marked
before its tags change and unmarked when its postings have followed, and marked shards are scanned.

Collections stay in numbered snapshots.  One writer at a time; a reader that began before a shard was
rewritten may have to begin again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as ops
from ..operators import postings
from .catalog import Catalog, normal_path
from .errors import BadInputError
from .shared import checkpointed

_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


class ShardedCatalog(Catalog):
    """Like :class:`Catalog`, for libraries too large to be written anew at every edit.

    ``shards`` and ``buckets`` count when the directory is new; afterwards its own hold.
    """

    #: Paths up to this number are looked for by value, so that shards, buckets and row groups are skipped.
    FEW = 200

    def __init__(self, spark: SparkSession, directory: str, shards: int = 16, buckets: int = 8):
        super().__init__(spark, directory)
        self.shards, self.buckets = self._layout(shards, buckets)
        self.name = "sampleyard_tags_" + hashlib.md5(self.directory.encode()).hexdigest()[:16]
        columns = ops.TAGS_DDL.replace("key string", "`key` string")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, shard int) USING parquet "
            f"OPTIONS ('parquet.bloom.filter.enabled#path'='true', 'parquet.bloom.filter.expected.ndv#path'='100000') "
            f"PARTITIONED BY (shard) CLUSTERED BY (path) SORTED BY (path) INTO {self.buckets} BUCKETS LOCATION '{self.directory}/tags'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _layout(self, shards: int, buckets: int) -> tuple[int, int]:
        """The numbers that the directory was made with."""
        fs, path = self._fs(), self._path("TAGS_LAYOUT")
        if fs.exists(path):
            held = self.spark.read.text(f"{self.directory}/TAGS_LAYOUT").first()[0].split()
            return int(held[0]), int(held[1])
        if shards < 1 or buckets < 1:
            raise BadInputError("a catalog has one shard and one bucket at least")
        fs.mkdirs(self._path("tags"))
        out = fs.create(path, True)
        out.write(bytearray(f"{shards} {buckets}\n".encode()))
        out.close()
        return shards, buckets

    # -- reads --

    @property
    def tags(self) -> DataFrame:
        return self.spark.table(self.name).drop("shard")

    def shard_of(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.shards)).cast("int")

    def at_paths(self, paths: list[str]) -> DataFrame:
        """The tag rows of some paths, by value: other shards and buckets are not opened, row groups without them skipped."""
        wanted = [F.lit(p) for p in dict.fromkeys(paths)]
        found = self.spark.table(self.name)
        if not wanted:
            return found.limit(0).drop("shard")
        rows = self.spark.range(1).select(F.explode(F.array(*wanted)).alias("p")).select(self.shard_of(F.col("p"))).distinct()
        return found.where(F.col("shard").isin([r[0] for r in rows.collect()]) & F.col("path").isin(wanted)).drop("shard")

    def get(self, path: str) -> DataFrame:
        return self.at_paths([normal_path(path)]).limit(1)

    def fresh(self, files: DataFrame, accept: list[str], rescan: bool = False) -> DataFrame:
        """``files(path, mtime, ...)`` with ``cached``; few files are looked up by value, many joined bucket by bucket."""
        some = [r[0] for r in files.select("path").limit(self.FEW + 1).collect()]
        return ops.fresh(files, self.tags if len(some) > self.FEW else self.at_paths([p for p in some if p is not None]), accept, rescan)

    def _marked(self) -> list[int]:
        """Shards whose postings may be behind their tags."""
        fs, root = self._fs(), self._path("behind")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(root)) if fs.exists(root) else []

    def postings(self, table: str) -> DataFrame:
        """``terms`` or ``grams``, with ``shard``."""
        schema = {"terms": "axis string, term string, path string, said string, shard int", "grams": "gram string, path string, shard int"}[table]
        if not self._fs().exists(self._path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.directory}/{table}")

    def query(self, *, collection: str | None = None, instrument: str | None = None, genre: str | None = None, path_like: str | None = None, **filters) -> DataFrame:
        """As of :class:`Catalog`; filters on instruments, genres and parts of paths go by postings."""
        tables, behind = [self.postings(t) for t in ("terms", "grams")], self._marked()
        by_value = {"instrument": instrument, "genre": genre, "path_like": path_like}
        if behind:  # not from the postings of these shards
            tables = [t.where(~F.col("shard").isin(behind)) for t in tables]
        found = postings.matching(*tables, **by_value)
        members = None if collection is None else ops.member_paths(self.table("collections"), self.table("collection_members"), collection)
        if found is None:
            return ops.query(self.tags, collection=members, **filters)
        found = checkpointed(found)
        some = [r[0] for r in found.limit(self.FEW + 1).collect()]
        rows = self.at_paths(some) if len(some) <= self.FEW else self.tags.join(found, "path", "left_semi")
        if behind:
            late = self.spark.table(self.name).where(F.col("shard").isin(behind)).drop("shard")
            rows = rows.unionByName(late)
        # what postings found is verified by the tags themselves
        return ops.query(rows, collection=members, **by_value, **filters)

    # -- writes --

    def _rewrite(self, paths: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the shards that hold ``paths(path)`` by what ``make`` makes of their rows."""
        touched = sorted(r[0] for r in paths.select(self.shard_of(F.col("path")).alias("shard")).distinct().collect())
        if not touched:
            return
        fs = self._fs()
        for s in touched:
            fs.create(self._path(f"behind/{s}"), True).close()
        held = self.spark.table(self.name).where(F.col("shard").isin(touched)).drop("shard")
        names = [f.name for f in ops.TAGS_SCHEMA.fields]
        new = checkpointed(make(held).select(*names).withColumn("shard", self.shard_of(F.col("path"))).repartition(self.buckets, "path"))  # one file for each bucket
        self._overwrite(lambda: new.write.insertInto(self.name, overwrite=True))
        for s in set(touched) - {r[0] for r in new.select("shard").distinct().collect()}:  # left without rows
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (shard={s})")
            fs.delete(self._path(f"tags/shard={s}"), True)
        self._index(touched)
        for s in touched:
            fs.delete(self._path(f"behind/{s}"), False)

    def _index(self, touched: list[int]) -> None:
        """Postings of some shards from their tags."""
        rows = self.spark.table(self.name).where(F.col("shard").isin(touched))
        for table, made, key in (("terms", postings.terms_of, ["axis", "term", "path"]), ("grams", postings.grams_of, ["gram", "path"])):
            out = made(rows).withColumn("shard", self.shard_of(F.col("path"))).repartition(len(touched), "shard").sortWithinPartitions("shard", *key)
            out = checkpointed(out)
            there = {r[0] for r in out.select("shard").distinct().collect()}
            self._overwrite(lambda out=out, table=table: out.sortWithinPartitions("shard", *key).write.partitionBy("shard").mode("overwrite").parquet(f"{self.directory}/{table}"))  # noqa: B023
            for s in set(touched) - there:
                self._fs().delete(self._path(f"{table}/shard={s}"), True)

    def _overwrite(self, write: Callable[[], None]) -> None:
        """Run a write that replaces the partitions it has rows for, and leave the session's setting as it was."""
        before = self.spark.conf.get(_OVERWRITE)
        self.spark.conf.set(_OVERWRITE, "dynamic")
        try:
            write()
        finally:
            self.spark.conf.set(_OVERWRITE, before)

    # -- edits --

    def upsert(self, new: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Rows of ``new``; a batch of a stream that stopped before its number was stored is merged again, which changes nothing."""
        new = checkpointed(ops.migrated(new).where(F.col("path").isNotNull()))  # read for its shards and for its rows
        self._rewrite(new, lambda held: ops.upsert(held, new))
        return self.commit(stream) if stream else self.version()

    def update(self, path: str, /, **fields) -> DataFrame:
        ops.checked_fields(fields)
        own = normal_path(path)
        self._rewrite(self.spark.createDataFrame([(own,)], "path string"), lambda held: ops.update(held, own, fields, time.time()))
        return self.get(path)

    def update_all(self, edits: DataFrame) -> int:
        edits = checkpointed(ops.normalised(edits, normal_path))
        self._rewrite(edits, lambda held: ops.update_all(held, edits, time.time()))
        return self.version()

    def delete(self, path: str) -> bool:
        if self.get(path).isEmpty():
            return False
        gone = self.spark.createDataFrame([(normal_path(path),)], "path string")
        self._rewrite(gone, lambda held: ops.delete(held, gone))
        return True

    def views(self) -> None:
        super().views()
        self.tags.createOrReplaceTempView("tags")
