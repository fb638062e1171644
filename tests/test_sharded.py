"""The bucketed catalog and its postings: the plain catalog's results, by plans that read less."""

import os

import pytest
from pyspark.sql import functions as F

from sampleyard.operators import catalog as ops
from sampleyard.operators import postings
from sampleyard.plans.projections import projected
from sampleyard.sources.catalog import Catalog
from sampleyard.sources.errors import BadInputError
from sampleyard.sources.sharded import ShardedCatalog

SMALL = "/root/testdata/sf0.001"


def library(spark):
    tags = projected(spark, SMALL, "lib_tags").withColumn("genres", ops.genres_from_json(F.col("genres_json")))
    return ops.migrated(tags)


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("cats")
    plain, sharded = Catalog(spark, f"file://{where}/plain"), ShardedCatalog(spark, f"file://{where}/sharded", shards=4, buckets=3)
    for c in (plain, sharded):
        c.upsert(library(spark))
    return plain, sharded


def rows(df):
    return sorted(map(repr, df.drop("scanned_at").collect()))


def files_of(store):
    """Path and time of every data file of the tags and postings."""
    root = store.directory.removeprefix("file://")
    return {f: os.stat(f).st_mtime_ns for t in ("tags", "terms", "grams") for d, _, names in os.walk(f"{root}/{t}") for f in (os.path.join(d, n) for n in names if n.endswith(".parquet"))}


FILTERS = [
    {"category": "bass"}, {"instrument": "BASS"}, {"instrument": "drums,kick"}, {"instrument": "k%k"}, {"instrument": "%"}, {"instrument": "nothing"}, {"instrument": ""}, {"genre": "House"},
    {"genre": "%house"}, {"genre": "deep"}, {"path_like": "KICK_p"}, {"path_like": "e"}, {"path_like": "%"}, {"path_like": "Loops/%90"}, {"path_like": "no such thing"}, {"path_like": "a_s/", "genre": "techno", "instrument": "bass"},
    {"path_like": "my takes", "kind": "loop", "order": "bpm", "limit": 7}, {"path_like": "#m Loops", "bpm_min": 90, "edited": False},
]


@pytest.mark.parametrize("filters", FILTERS, ids=str)
def test_filters_by_postings_find_what_scans_find(stores, filters):
    plain, sharded = stores
    assert rows(sharded.query(**filters)) == rows(plain.query(**filters))


def test_posting_filters_read_postings_only(spark, stores):
    _, sharded = stores
    terms, grams = sharded.postings("terms"), sharded.postings("grams")
    plan = postings.matching(terms, grams, instrument="bass", path_like="kick")._jdf.queryExecution().toString()
    assert "/tags" not in plan and "EqualTo(term,bass)" in plan and "In(gram, [" in plan
    assert postings.literal_runs("Loops/%90_x") == ["loo", "oop", "ops", "ps/"] and postings.literal_runs("a%b") == []


def test_a_join_with_the_tags_does_not_shuffle_them(spark, stores):
    _, sharded = stores
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.range(1000).select(F.concat(F.lit("/x/"), F.col("id").cast("string")).alias("path"), F.lit(1.0).alias("mtime"))
        plan = ops.fresh(files, sharded.tags, ["auto"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, tags = plan[: plan.index("Scan parquet")], plan[plan.index("Scan parquet") :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in tags
    assert "Range" in plan[plan.index("Exchange hashpartitioning") :] and above


def scanned(df):
    """Rows that the scan of a plan gave, and the files that it read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.toString()[:30] else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value(), leaf.metrics().get("numFiles").get().value()


def test_point_reads_open_one_bucket_and_skip_row_groups(spark, stores):
    _, sharded = stores
    some = sharded.tags.select("path").orderBy("path").collect()
    there = some[len(some) // 2]["path"]
    assert sharded.get(there).first()["path"] == there
    total = sharded.tags.count()
    found, files = scanned(sharded.at_paths([there]))
    assert files == 3 and 0 < found < total / 8  # a shard's files are listed, one bucket of it is read
    # paths between the least and the greatest of their bucket: only bloom filters can tell that they are not there
    absent = [f"{some[len(some) // 2 + k]['path']}x" for k in range(20)]
    assert sum(scanned(sharded.at_paths([p]))[0] for p in absent) <= found * 2


def test_edits_rewrite_their_shards_alone(spark, tmp_path):
    plain, sharded = Catalog(spark, f"file://{tmp_path}/plain"), ShardedCatalog(spark, f"file://{tmp_path}/sharded", shards=6, buckets=2)
    for c in (plain, sharded):
        c.upsert(library(spark).limit(300).orderBy("path"))
    target = plain.tags.agg(F.min("path")).first()[0]

    def own(path):
        return f"shard={sharded.tags.sparkSession.range(1).select(sharded.shard_of(F.lit(path))).first()[0]}/"

    for edit in (
        lambda c: c.update(target, category="tom", instruments=["gong"]),
        lambda c: c.upsert(ops.migrated(spark.createDataFrame([(target, "hat", 9.0)], "path string, category string, mtime double"))),
        lambda c: c.update_all(spark.createDataFrame([(target, "rim"), (target, "clap")], "path string, category string")),
        lambda c: c.delete(target),
        lambda c: c.delete(target),
    ):
        before = files_of(sharded)
        for c in (plain, sharded):
            edit(c)
        after = files_of(sharded)
        assert {f for f in before if own(target) not in f} == {f for f in after if own(target) not in f}
        assert all(after[f] == t for f, t in before.items() if own(target) not in f)
        assert rows(sharded.tags) == rows(plain.tags) and sharded._marked() == []
        assert rows(sharded.query(instrument="gong")) == rows(plain.query(instrument="gong"))
    with pytest.raises(BadInputError):
        sharded.update(target)


def test_a_shard_left_without_rows_and_opening_again(spark, tmp_path):
    store = ShardedCatalog(spark, f"file://{tmp_path}/c", shards=5, buckets=2)
    assert store.tags.count() == 0 and store.query(path_like="abc").count() == 0 and not store.delete("/a.wav")
    store.update("/a.wav", category="kick", instruments=["drums"])
    assert store.query(instrument="drums").count() == 1 and store.delete("/a.wav")
    assert store.tags.count() == 0 and store.query(instrument="drums").count() == 0 and store.postings("grams").count() == 0
    store.update("/b.wav", category="bass")
    spark.sql(f"DROP TABLE {store.name}")  # a new session knows nothing of it
    again = ShardedCatalog(spark, f"file://{tmp_path}/c", shards=99, buckets=99)
    assert (again.shards, again.buckets) == (5, 2) and [r["path"] for r in again.query(path_like="B.W").collect()] == ["/b.wav"]
    again.collection_add("Set", ["/b.wav"])
    assert again.query(collection="Set", path_like=".wav").count() == 1
    again.views()
    assert spark.sql("select count(*) from tags").first()[0] == 1


def test_postings_that_are_behind_are_not_trusted(spark, tmp_path):
    """A writer that stopped between tags and postings leaves a mark: its shard is scanned."""
    store = ShardedCatalog(spark, f"file://{tmp_path}/c", shards=2, buckets=1)
    store.update("/a/kick.wav", category="kick", instruments=["drums"])
    index, store._index = store._index, lambda touched: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError):
        store.update("/a/kick.wav", instruments=["gong"])
    store._index = index
    assert store._marked() and store.query(instrument="gong").count() == 1 and store.query(instrument="drums").count() == 0
    store.update("/a/kick.wav", category="tom")
    assert store._marked() == [] and store.query(instrument="gong").count() == 1


def test_few_files_are_looked_up_by_value(spark, stores):
    plain, sharded = stores
    known = [(r["path"], r["mtime"]) for r in plain.tags.select("path", "mtime").orderBy("path").limit(5).collect()]
    files = spark.createDataFrame([*known, ("/none.wav", 1.0), (None, None)], "path string, mtime double")
    key = lambda r: str(r["path"])
    got, want = sharded.fresh(files, ["auto", "clap"]), ops.fresh(files, plain.tags, ["auto", "clap"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert "In(path, [" in got._jdf.queryExecution().toString()
