"""Model batches by length, label products, and a scan's counts from its own writes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sampleyard.functions import similarity
from sampleyard.operators import recognisers, scan
from sampleyard.sources.errors import BadInputError
from sampleyard.sources.shared import checkpointed


def test_batches_stay_within_their_padded_seconds(spark):
    rng = np.random.default_rng(2)
    lengths = [None, 0.0, 0.2, 1.0, 59.9, 60.0, 500.0, *[7.0] * 40, *(rng.random(300) * 90).tolist()]
    rows = spark.createDataFrame([(f"/{i}", x) for i, x in enumerate(lengths)], "path string, duration double").repartition(5)
    got = scan.packed_batches(rows, 60.0, 8).collect()
    assert sorted(r["path"] for r in got) == sorted(f"/{i}" for i in range(len(lengths)))
    batches = {}
    for r in got:
        batches.setdefault((r["length"], r["batch"]), []).append(max(1.0, r["duration"] or 1.0))
    for (length, _), own in batches.items():
        assert len(own) <= 8 and (len(own) * length <= 60.0 + 1e-6 or len(own) == 1)
        assert all(length / 2**0.25 - 1e-6 < x <= length + 1e-6 for x in own)
    # all batches of a length but its last are full
    for length in {k[0] for k in batches}:
        sizes = sorted(len(v) for k, v in batches.items() if k[0] == length)
        assert len(set(sizes[1:])) <= 1
    with pytest.raises(BadInputError):
        scan.packed_batches(rows, 0.0, 8)
    assert scan.packed_batches(rows.limit(0), 60.0, 8).count() == 0


def test_captioner_gets_packs_and_halves_of_those_that_fail(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def captioner():
        def said(paths):
            (calls / f"{abs(hash(tuple(paths)))}").write_text("\n".join(paths))
            if any("bad" in p for p in paths):
                raise ValueError(paths)
            return [f"a kick in {p}" for p in paths]

        return said

    rows = [(f"/{i}.wav", 3.0 if i % 2 else 50.0, i) for i in range(41)] + [("/bad.wav", 3.0, 99), ("/none.wav", None, 98)]
    files = spark.createDataFrame(rows, "path string, duration double, n int").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # packs go on over Arrow batches
    try:
        got = recognisers.with_captions(files, captioner, batch=8, seconds=100.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["path"]: (r["caption"], r["n"]) for r in got} == {p: (None if "bad" in p else f"a kick in {p}", n) for p, _, n in rows} and len(got) == len(rows)
    seconds = {p: d for p, d, _ in rows}
    asked = [f.read_text().split("\n") for f in calls.iterdir()]
    assert all(len({seconds[p] for p in a}) == 1 for a in asked)  # clips of one length together
    assert max(len(a) for a in asked if seconds[a[0]] == 3.0) == 8 and max(len(a) for a in asked if seconds[a[0]] == 50.0) == 1
    retried = [len(a) for a in asked if "/bad.wav" in a]
    assert sorted(retried) == [1, *sorted(retried)[1:]] and len(retried) <= 4  # 8, 4, 2, 1


def test_a_run_of_the_captioner_is_recorded(spark, tmp_path):
    from pyspark.sql import Observation

    from sampleyard.sources import audio

    def captioner():
        def said(paths):
            if "/3" in paths:
                raise ValueError(paths)
            return ["x" for _ in paths]

        return said

    counts = Observation()
    files = spark.createDataFrame([(f"/{i}", 2.0) for i in range(20)], "path string, duration double")
    made = recognisers.with_captions(files, captioner, batch=8, counts=counts)
    assert made.columns == ["path", "duration", "caption"]
    made.write.parquet(f"{tmp_path}/captions")
    record = recognisers.run_record(spark, counts)
    r = record.first()
    assert (r["event"], r["files"], r["captioned"], r["failed"], r["batches"]) == ("captions", 20, 19, 1, 3) and r["seconds"] > 0 and 0 <= r["load_share"] <= 1
    assert audio.append_analytics(record, f"file://{tmp_path}/log") and spark.read.json(f"file://{tmp_path}/log").first()["files"] == 20


def test_captions_without_lengths_and_with_short_answers(spark):
    files = spark.createDataFrame([(f"{i}",) for i in range(5)], "path string").coalesce(1)
    got = recognisers.with_captions(files, lambda: lambda paths: ["x"] if len(paths) > 1 else [f"one {paths[0]}"], batch=3).collect()
    assert [r["caption"] for r in got] == [f"one {i}" for i in range(5)]


def test_label_products(spark):
    labels = np.random.default_rng(0).normal(size=(3, 4))
    rows = [[1.0, 2.0, 3.0, 4.0], None, [], [1.0, None, 0.0, 0.0], [0.5, 0.0, 0.0, -1.0], [1.0, 2.0], [float("nan"), 0.0, 0.0, 0.0]]
    got = similarity.products(pa.array(rows, pa.list_(pa.float32())), labels).to_pylist()
    assert got[0] == pytest.approx((labels @ np.array(rows[0])).tolist()) and got[4] == pytest.approx((labels @ np.array(rows[4])).tolist())
    assert got[1] is got[2] is got[3] is got[5] is None and np.isnan(got[6]).all()
    assert similarity.products(pa.array(rows, pa.list_(pa.float64())).slice(4, 1), labels).to_pylist()[0] == pytest.approx(got[4])
    assert similarity.products(pa.array([], pa.list_(pa.float64())), labels).to_pylist() == []
    df = spark.createDataFrame([(r,) for r in rows[:3]], "e array<float>")
    sizes = [len(df.select(similarity.similarities(F.col("e"), np.zeros((5, w)).tolist()))._jdf.queryExecution().toString()) for w in (4, 512)]
    assert abs(sizes[0] - sizes[1]) < 100  # the plan does not grow with the width
    assert [r[0] and len(r[0]) for r in df.select(similarity.similarities(F.col("e"), labels.tolist())).collect()] == [3, None, None]


def test_scan_counts_come_from_the_scan_itself(spark):
    files = spark.createDataFrame([(f"/{n}.wav", 1.0, 0.5) for n in ("kick", "bass", "thing", "fx", "x")], "path string, mtime double, duration double")
    tags = spark.createDataFrame([("/kick.wav", 1.0, "auto", False, "kick", ["drums"]), ("/fx.wav", 1.0, "auto", False, "fx", [])], "path string, mtime double, backend string, edited boolean, category string, instruments array<string>")
    tier = lambda name: lambda df: scan.classify(df, None, name)
    counts = scan.ScanCounts()
    stored, status = scan.progressive(files, tags, tier("auto"), tier("clap"), second_name="clap", keep=checkpointed, counts=counts, carry={"category": "old"})
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    got = counts.get()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == jobs  # nothing ran for them
    by_status = {s: sum(r["status"] == s for r in status.collect()) for s in ("classify", "cached", "escalate")}
    second = sum(r["backend"] == "clap" for r in stored.collect())
    assert got == {"classified": by_status["classify"], "cached": by_status["cached"], "escalated": second} and by_status["escalate"] == 1 and second > 1
    assert {r["path"]: r["old"] for r in status.collect()}["/kick.wav"] == "kick"
    one = scan.ScanCounts()
    scan.progressive(files, tags, tier("auto"), keep=checkpointed, counts=one)
    assert one.get() == {"classified": 3, "cached": 2, "escalated": 0}
    plan = scan.progressive(files, tags, tier("auto"), tier("clap"), second_name="clap")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # doubtful rows are filtered, not joined back
