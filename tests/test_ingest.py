"""Streams of new and changed files into a catalog: state, replays, guards and the second tier."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleyard.operators import scan
from sampleyard.plans import queries
from sampleyard.sources import audio
from sampleyard.sources.catalog import Catalog
from sampleyard.sources.sharded import ShardedCatalog
from sampleyard.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    for name in ("kick_01.wav", "thing.wav", "other.wav"):
        (lib / name).write_bytes(audio.encode_wav(np.sin(np.arange(4000) / 9), 8000))
    return lib


def first(df):
    return scan.classify(audio.with_durations(ingest.with_content(df)).join(df.select("path", "mtime"), "path"), None, "auto")


def second(df):
    return scan.classify(df.withColumn("duration", F.lit(None).cast("double")), None, "clap").withColumn("category", F.lit("melodic"))


def step(spark, folder, store, tmp_path, state="a", hand_on=None):
    """Announce the folder as it is now, and run the first tier over what is new."""
    ingest.announce(audio.list_files(spark, str(folder)), f"file://{tmp_path}/log")
    query = ingest.ingest(ingest.changes(spark, f"file://{tmp_path}/log"), store, first, f"{tmp_path}/state-{state}", hand_on, second="clap", stream=state)
    query.awaitTermination()


def tags(store):
    return {r["path"].rsplit("/", 1)[1]: r for r in store.tags.collect()}


@pytest.mark.parametrize("kind", [Catalog, ShardedCatalog])
def test_changed_files_come_again_and_others_do_not(spark, folder, tmp_path, kind):
    store = kind(spark, f"file://{tmp_path}/cat-{kind.__name__}")
    step(spark, folder, store, tmp_path)
    before = tags(store)
    assert set(before) == {"kick_01.wav", "thing.wav", "other.wav"} and before["kick_01.wav"]["category"] == "kick"
    step(spark, folder, store, tmp_path)  # nothing new
    assert {n: r["scanned_at"] for n, r in tags(store).items()} == {n: r["scanned_at"] for n, r in before.items()}
    os.utime(folder / "thing.wav", (2e9, 2e9))
    (folder / "new kick.wav").write_bytes((folder / "thing.wav").read_bytes())
    step(spark, folder, store, tmp_path)
    after = tags(store)
    assert len(after) == 4 and {n for n in before if after[n]["scanned_at"] != before[n]["scanned_at"]} == {"thing.wav"} and after["thing.wav"]["mtime"] == 2e9


def test_a_stream_begun_anew_leaves_fresh_and_edited_rows_alone(spark, folder, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/cat")
    step(spark, folder, store, tmp_path)
    path = next(r["path"] for r in store.tags.collect() if "kick" in r["path"])
    store.commit(tags=store.tags.withColumn("edited", F.col("path") == path).withColumn("category", F.when(F.col("path") == path, "mine").otherwise(F.col("category"))))
    os.utime(folder / "kick_01.wav", (2e9, 2e9))
    before = tags(store)
    step(spark, folder, store, tmp_path, state="b")
    assert tags(store) == before and before["kick_01.wav"]["category"] == "mine"


def test_a_batch_that_runs_again_makes_no_second_commit(spark, folder, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/cat")
    batch = audio.list_files(spark, str(folder)).select("path", "mtime")
    assert ingest.store_batch(batch, 0, store, first, "s", ["auto"]) and store.streamed("s") == 0
    version = store.version()
    assert not ingest.store_batch(batch, 0, store, first, "s", ["auto"]) and store.version() == version
    assert store.streamed("other") == -1
    store.collection_add("Set", ["/x"])
    assert store.streamed("s") == 0  # later commits keep it
    twice = batch.unionByName(batch.withColumn("mtime", F.col("mtime") + 5))
    assert ingest.store_batch(twice, 1, store, first, "s", ["auto"]) and store.tags.count() == 3


def test_two_tiers(spark, folder, tmp_path):
    """A second tier with a model that does not load takes nothing from the first, and goes on where it stopped."""
    store, hand_on = Catalog(spark, f"file://{tmp_path}/cat"), f"file://{tmp_path}/doubtful"
    step(spark, folder, store, tmp_path, hand_on=hand_on)

    def broken(df):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        ingest.escalate(spark, hand_on, store, broken, f"{tmp_path}/second", "clap").awaitTermination()
    held = tags(store)
    assert len(held) == 3 and {r["backend"] for r in held.values()} == {"auto"}
    ingest.escalate(spark, hand_on, store, second, f"{tmp_path}/second", "clap").awaitTermination()
    placed = tags(store)
    assert {n: (r["backend"], r["category"]) for n, r in placed.items()} == {"kick_01.wav": ("auto", "kick"), "thing.wav": ("clap", "melodic"), "other.wav": ("clap", "melodic")}
    version = store.version()
    ingest.escalate(spark, hand_on, store, second, f"{tmp_path}/second", "clap").awaitTermination()  # nothing handed on since
    assert store.version() == version
    step(spark, folder, store, tmp_path, hand_on=hand_on)  # the second tier's rows are fresh to the first
    assert tags(store) == placed


def test_batches_are_counted_by_listings_not_by_files(spark, tmp_path, monkeypatch):
    """three listings of many files each come in three batches, and what was seen in one is not new in the next."""
    d = f"file://{tmp_path}/data"
    spark.range(400).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 7 as user_id", "'x' as event_type", "1.0d as value").repartition(9).write.parquet(f"{d}/events.parquet")
    monkeypatch.setattr(queries, "shared_folder", lambda spark: f"file://{tmp_path}")
    small = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a partition for each file, however small
    try:
        rows = queries.stream_changes(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", small)
    assert len(rows) == len(set(rows)) == 480
    (folder,) = tmp_path.glob("changes-*")
    assert len(list((folder / "log").glob("*.parquet"))) == 27
    counts = {p.name: spark.read.parquet(f"file://{p}").count() for p in (folder / "out").iterdir() if p.name.startswith("batch=")}
    assert sorted(n for n in counts.values() if n) == [80, 400] and len(counts) <= 6  # three have no rows but move the watermark
