"""Catalog snapshots, filters, edits, collections, scans and plans."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sampleyard.operators import catalog as ops
from sampleyard.operators import recognisers, scan
from sampleyard.sources import audio
from sampleyard.sources.catalog import Catalog, normal_path
from sampleyard.sources.errors import BadInputError


def rows(spark, *tags):
    names = ["path", "category", "bpm", "backend", "mtime", "instruments"]
    schema = "path string, category string, bpm double, backend string, mtime double, instruments array<string>"
    return ops.migrated(spark.createDataFrame([tuple(t.get(n) for n in names) for t in tags], schema))


@pytest.fixture
def store(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    c.upsert(rows(spark, {"path": "/a/kick.wav", "category": "kick", "bpm": 90.0, "backend": "auto", "mtime": 1.0, "instruments": ["drums"]}, {"path": "/b/snare.wav", "category": "snare", "bpm": 140.0, "backend": "auto", "mtime": 2.0}, {"path": "/b/bass.wav", "category": "bass", "bpm": None, "backend": "clap", "mtime": 3.0}))
    return c


def paths(df):
    return [r["path"] for r in df.collect()]


def test_filters(store):
    assert paths(store.query(category="kick")) == ["/a/kick.wav"]
    assert paths(store.query(bpm_min=90, bpm_max=140)) == ["/a/kick.wav", "/b/snare.wav"]
    assert paths(store.query(path_like="SNARE")) == ["/b/snare.wav"]
    assert paths(store.query(instrument="DRUMS")) == ["/a/kick.wav"]
    assert paths(store.query(order="bpm", limit=2)) == ["/b/bass.wav", "/a/kick.wav"]
    assert len(paths(store.query(limit=-1))) == 3
    for bad in ({"order": "nope"}, {"colour": "red"}):
        with pytest.raises(BadInputError):
            store.query(**bad)


def test_edits_survive_upserts(spark, store):
    row = store.update("/a/kick.wav", category="tom", genres=[{"genre": "house", "score": 0.5}]).first()
    assert row["edited"] and row["category"] == "tom" and row["genres"][0]["genre"] == "house"
    store.upsert(rows(spark, {"path": "/a/kick.wav", "category": "hat", "mtime": 9.0}))
    again = store.get("/a/kick.wav").first()
    assert again["edited"] and again["category"] == "hat"
    made = store.update("/new/x.wav", bpm=100.0).first()
    assert made["filename"] == "x.wav" and made["edited"] and made["bpm"] == 100.0
    assert store.delete("/new/x.wav") and not store.delete("/new/x.wav")
    assert paths(store.query(genre="HOUSE")) == []  # the upsert replaced the genres
    for bad in ({}, {"path": "x"}):
        with pytest.raises(BadInputError):
            store.update("/a/kick.wav", **bad)


def test_a_failed_write_leaves_the_snapshot_before(spark, store):
    before, version = sorted(paths(store.query())), store.version()
    spark.range(3).write.parquet(f"{store.directory}/v={version + 1}/tags")  # a writer that stopped before its manifest
    assert store.version() == version and sorted(paths(store.query())) == before
    store.collection_add("Set", ["/a/kick.wav"])
    assert store.version() == version + 2 and store._manifest(store.version())["tags"] == version  # tags are not written again
    assert paths(store.query(collection="Set")) == ["/a/kick.wav"]


def test_repeated_paths_and_batches_of_edits(spark, store):
    store.upsert(rows(spark, {"path": "/r.wav", "category": "hat", "mtime": 1.0}, {"path": "/r.wav", "category": "tom", "mtime": 5.0}, {"path": "/r.wav", "category": "rim", "mtime": None}))
    assert [r["category"] for r in store.get("/r.wav").collect()] == ["tom"] and store.tags.count() == 4
    store.update_all(spark.createDataFrame([("/r.wav", "kick", None), ("/new/y.wav", None, 99.0)], "path string, category string, bpm double"))
    got = {r["path"]: r for r in store.tags.collect()}
    assert (got["/r.wav"]["category"], got["/r.wav"]["edited"], got["/new/y.wav"]["bpm"], got["/new/y.wav"]["filename"], got["/new/y.wav"]["edited"]) == ("kick", True, 99.0, "y.wav", True)
    assert got["/new/y.wav"]["instruments"] == [] and not got["/b/bass.wav"]["edited"] and len(got) == 5


def test_paths_are_normalised(store, monkeypatch):
    monkeypatch.setenv("HOME", "/b")
    assert store.get("~/snare.wav").first()["category"] == "snare" and store.get("/a/../b/./bass.wav").first()["category"] == "bass"
    assert normal_path("s3://x/a/../b") == "s3://x/a/../b"
    store.collection_add("Home", ["~/snare.wav"])
    assert paths(store.query(collection="Home")) == ["/b/snare.wav"]
    assert store.delete("~/snare.wav") and not store.delete("/b/snare.wav")


def test_imports_are_kept_by_content(spark, store, tmp_path):
    uploads = spark.createDataFrame([(bytearray(b"one"), "My Kick.WAV"), (bytearray(b"one"), "other kick.wav"), (bytearray(b"two"), None)], "content binary, name string")
    classifier = lambda df: scan.classify(df.select("path", "mtime", F.lit(None).cast("double").alias("duration")), None, "auto")
    for _ in range(2):
        got = store.import_uploads(uploads, f"{tmp_path}/blobs", classifier).collect()
        assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == sorted(f"{hashlib.sha1(c).hexdigest()}.wav" for c in (b"one", b"two"))
        assert store.tags.count() == 5 and len(list((tmp_path / "blobs").glob("*"))) == 2
    assert [r["category"] for r in got if "ick" in r["filename"]] == ["kick"]
    assert (tmp_path / "blobs" / f"{hashlib.sha1(b'two').hexdigest()}.wav").read_bytes() == b"two"


def test_analytics_and_batch_setting(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    run = spark.createDataFrame([("/a.wav", 0.5)], "path string, seconds double")
    assert not audio.append_analytics(run)
    monkeypatch.setenv("SAMPLEYARD_CAPTIONER_ANALYTICS", f"file://{tmp_path}/runs")
    assert audio.append_analytics(run) and audio.append_analytics(run)
    assert [(r["path"], r["ts"] > 1e9) for r in spark.read.json(f"file://{tmp_path}/runs").collect()] == [("/a.wav", True)] * 2
    for said, size in (("3", 3), ("0", 1), ("x", 8)):
        monkeypatch.setenv("SAMPLEYARD_CAPTIONER_BATCH", said)
        assert recognisers.batch_size() == size


def test_collections(store):
    assert store.collection_create(" Set ")["count"] == 0
    assert store.collection_add("Set", ["/a/kick.wav", "/gone.wav", "/a/kick.wav"]) == 2
    assert store.collection_create("Set")["count"] == 0
    assert paths(store.query(collection="Set")) == ["/a/kick.wav"]
    assert store.collection_rename("Set", "Other")["count"] == 2
    assert store.collection_remove("Other", ["/gone.wav"]) == 1
    store.collection_create("Second")
    with pytest.raises(BadInputError):
        store.collection_rename("Second", "Other")
    with pytest.raises(BadInputError):
        store.collection_remove("None", [])
    with pytest.raises(BadInputError):
        store.collection_create("  ")
    assert [(r["name"], r["count"]) for r in store.collections().collect()] == [("Other", 1), ("Second", 0)]
    assert store.collection_delete("Second") and not store.collection_delete("Second")
    assert store.collection_create("Third")["id"] == 3  # ids are not used again
    assert store.collection_delete("Other") and store.table("collection_members").count() == 0


def test_freshness_and_scan(spark, store):
    files = spark.createDataFrame([("/a/kick.wav", 1.0, 0.5), ("/b/snare.wav", 99.0, 0.5), ("/b/bass.wav", 3.0, 0.5), ("/c/new.wav", None, 0.5)], "path string, mtime double, duration double")
    got = {r["path"]: r["cached"] for r in ops.fresh(files, store.tags, ["auto"]).collect()}
    assert got == {"/a/kick.wav": True, "/b/snare.wav": False, "/b/bass.wav": False, "/c/new.wav": False}
    first = lambda df: scan.classify(df, None, "auto")
    stored, status = scan.progressive(files, store.tags, first, first, primary="auto", second_name="clap")
    assert {r["path"]: r["status"] for r in status.collect()} == {"/a/kick.wav": "cached", "/b/snare.wav": "classify", "/b/bass.wav": "cached", "/c/new.wav": "classify"}
    assert sorted(paths(stored)) == ["/b/snare.wav", "/c/new.wav"]
    assert all(r["status"] == "classify" for r in scan.scan_status(files, store.tags, "auto", rescan=True).collect())


def test_stored_forms(spark):
    df = spark.createDataFrame([('[{"genre":"a","score":0.5}]', "x,,y"), ("bad", ""), (None, None)], "g string, i string")
    got = df.select(F.size(ops.genres_from_json(F.col("g"))), ops.instruments_from_text(F.col("i"))).collect()
    assert [tuple(r) for r in got] == [(1, ["x", "y"]), (0, []), (0, [])]
    assert ops.query_string_filters({"edited": "no", "bpm_min": "90", "limit": "3"}) == {"edited": False, "bpm_min": 90.0, "limit": 3}


def test_plans(spark, store):
    plan = store.query(collection="x", category="kick")._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "EqualTo(category,kick)" in plan
    batches = scan.length_batches(spark.createDataFrame([(i, float(i % 5) if i % 3 else None) for i in range(23)], "file_id long, duration double"), 4)
    ordered = sorted(batches.collect(), key=lambda r: (r["duration"] or 0.0, r["file_id"]))
    assert [r["batch"] for r in ordered] == [i // 4 for i in range(23)]
