"""A catalog directory: Parquet tables in numbered snapshots.

``<dir>/v=<n>/MANIFEST.json`` says in which snapshot's folder each of the three tables lies.  A write
makes the tables that changed in a new folder and its manifest last, by rename; the snapshot in
force is the greatest with a manifest.  So readers see whole snapshots, a crash leaves the one
before, unchanged tables are not written again, and a plan never overwrites what it reads.  One
writer at a time.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog as ops
from ..operators import scan
from . import audio
from .errors import BadInputError, SampleyardError
from .shared import checkpointed

TABLES = {"tags": ops.TAGS_DDL, "collections": ops.COLLECTIONS_DDL, "collection_members": ops.MEMBERS_DDL}


def normal_path(path: str) -> str:
    """A local path made absolute, home and dots resolved; a URI as it is."""
    return path if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else os.path.realpath(os.path.expanduser(path))


class Catalog:
    """Reads and writes of one catalog directory (any file system Spark knows)."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    # -- snapshots --

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _snapshots(self) -> list[int]:
        """Numbers of all snapshot folders, complete or not."""
        fs, root = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.directory)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def version(self) -> int:
        """The snapshot in force, 0 before the first write."""
        fs = self._fs()
        return next((n for n in reversed(self._snapshots()) if fs.exists(self._path(f"v={n}/MANIFEST.json"))), 0)

    def _manifest(self, version: int) -> dict[str, int]:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.directory}/v={version}/MANIFEST.json", wholetext=True).first()[0])

    def table(self, name: str) -> DataFrame:
        schema = T.StructType.fromDDL(TABLES[name])
        held = self._manifest(self.version()).get(name)
        if held is None:
            return self.spark.createDataFrame([], schema)
        return ops.migrated(self.spark.read.parquet(f"{self.directory}/v={held}/{name}"), schema)

    def streamed(self, stream: str) -> int:
        """The last batch of a stream that a commit has, -1 before the first."""
        return self._manifest(self.version()).get(f"stream {stream}", -1)

    def commit(self, stream: tuple[str, int] | None = None, **changed: DataFrame) -> int:
        """Write the changed tables, then the manifest of the snapshot that has them, and the number of the stream's batch they come from."""
        fs = self._fs()
        manifest = self._manifest(self.version()) | ({f"stream {stream[0]}": stream[1]} if stream else {})
        version = max(self._snapshots(), default=0) + 1  # a folder left by a writer that failed is not used
        for name, df in changed.items():
            if name == "tags":
                df = df.repartitionByRange("path").sortWithinPartitions("path")  # so that files and row groups have ranges of paths of their own
            df.write.parquet(f"{self.directory}/v={version}/{name}")
            manifest[name] = version
        made = self._path(f"v={version}/MANIFEST.new")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(made, self._path(f"v={version}/MANIFEST.json")):
            raise SampleyardError(f"snapshot {version} of {self.directory} could not be completed")
        return version

    # -- tags --

    @property
    def tags(self) -> DataFrame:
        return self.table("tags")

    def query(self, *, collection: str | None = None, **filters) -> DataFrame:
        paths = None if collection is None else ops.member_paths(self.table("collections"), self.table("collection_members"), collection)
        return ops.query(self.tags, collection=paths, **filters)

    def get(self, path: str) -> DataFrame:
        return self.tags.where(F.col("path") == normal_path(path)).limit(1)

    def upsert(self, new: DataFrame, stream: tuple[str, int] | None = None) -> int:
        return self.commit(stream, tags=ops.upsert(self.tags, ops.migrated(new)))

    def update(self, path: str, /, **fields) -> DataFrame:
        self.commit(tags=ops.update(self.tags, normal_path(path), fields, time.time()))
        return self.get(path)

    def update_all(self, edits: DataFrame) -> int:
        """A batch of edits (path, <editable columns>) in one commit."""
        return self.commit(tags=ops.update_all(self.tags, ops.normalised(edits, normal_path), time.time()))

    def delete(self, path: str) -> bool:
        if self.get(path).isEmpty():
            return False
        self.commit(tags=self.tags.where(F.col("path") != normal_path(path)))
        return True

    def import_uploads(self, uploads: DataFrame, folder: str, classifier: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Keep ``uploads(content, name)`` as files named by content in ``folder`` and upsert their tag rows; returns these.

        A file that is there already is not written again, and the same content comes to the same row.
        """
        folder = folder.rstrip("/")
        uploads = checkpointed(uploads.select("content", "name"))  # read several times
        audio.write_blobs(scan.addressed(uploads).dropDuplicates(["digest", "ext"]), folder)
        made = checkpointed(scan.imported(uploads, folder, classifier).withColumn("mtime", F.lit(time.time())).withColumn("scanned_at", F.lit(time.time())))
        self.upsert(made)
        return self.tags.join(made.select("path"), "path", "left_semi")

    def views(self) -> None:
        """Register the tables as temporary views for free SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    # -- collections --

    def collections(self) -> DataFrame:
        return ops.collection_counts(self.table("collections"), self.table("collection_members"))

    def _id(self, name: str) -> int | None:
        row = self.table("collections").where(F.col("name") == name).select("id").first()
        return row and row[0]

    def collection_create(self, name: str) -> dict:
        """Idempotent; the returned count is always 0."""
        name = name.strip()
        if not name:
            raise BadInputError("a collection needs a name")
        own, made = self._made(name)
        if made is not None:
            self.commit(collections=made)
        return {"id": own, "name": name, "count": 0}

    def _made(self, name: str) -> tuple[int, DataFrame | None]:
        """A collection's id, and the table of collections with it where it is new."""
        own = self._id(name)
        if own is not None:
            return own, None
        own = max(self.table("collections").agg(F.max("id")).first()[0] or 0, self._high_water()) + 1
        self._high_water(own)
        return own, self.table("collections").unionByName(self.spark.createDataFrame([(own, name, time.time())], ops.COLLECTIONS_DDL))

    def _high_water(self, value: int | None = None) -> int:
        """The largest id ever given; ids are not used again."""
        path = f"{self.directory}/LAST_ID"
        if value is not None:
            out = self._fs().create(self._path("LAST_ID"), True)
            out.write(bytearray(f"{value}\n".encode()))
            out.close()
            return value
        return int(self.spark.read.text(path).first()[0]) if self._fs().exists(self._path("LAST_ID")) else 0

    def collection_rename(self, name: str, new_name: str) -> dict:
        new_name, own = new_name.strip(), self._id(name)
        if own is None:
            raise BadInputError(f"no collection {name!r}")
        if not new_name:
            raise BadInputError("a collection needs a name")
        if new_name != name:
            if self._id(new_name) is not None:
                raise BadInputError(f"collection {new_name!r} exists")
            self.commit(collections=self.table("collections").withColumn("name", F.when(F.col("id") == own, new_name).otherwise(F.col("name"))))
        return self.collections().where(F.col("id") == own).first().asDict()

    def collection_delete(self, name: str) -> bool:
        if self._id(name) is None:
            return False
        collections, members = ops.delete_collection(self.table("collections"), self.table("collection_members"), name)
        self.commit(collections=collections, collection_members=members)
        return True

    def _paths(self, own: int, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(own, normal_path(p), time.time()) for p in paths], ops.MEMBERS_DDL)

    def collection_add(self, name: str, paths: list[str]) -> int:
        name = name.strip()
        if not name:
            raise BadInputError("a collection needs a name")
        own, made = self._made(name)
        members = ops.add_members(self.table("collection_members"), self._paths(own, paths))
        self.commit(collection_members=members, **({} if made is None else {"collections": made}))
        return self.table("collection_members").where(F.col("collection_id") == own).count()

    def collection_remove(self, name: str, paths: list[str]) -> int:
        own = self._id(name)
        if own is None:
            raise BadInputError(f"no collection {name!r}")
        self.commit(collection_members=ops.remove_members(self.table("collection_members"), self._paths(own, paths)))
        return self.table("collection_members").where(F.col("collection_id") == own).count()
