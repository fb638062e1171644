"""The pipeline against its stages' operators done by brute force on small tables."""

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sampleyard.llm import byte_bpe, common, ngram_join, queries

from . import odd


def test_each_stage_takes_effect(spark):
    docs = queries.table(spark, odd.SMALL, "documents")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = [texts]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, odd.SMALL), "test-stage")
        assert docs.columns == columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert set(kept[-1]) <= set(kept[-2]) and docs.count() == len(kept[-1])
    # near duplicates: one of each group of brute force stays
    least = odd.linked_groups(kept[2], list(odd.jaccard_links(kept[2])))
    assert set(kept[3]) == {i for i in kept[2] if least[i] == i}
    # decontamination: none that holds an item stays, no other goes
    items = [odd.shingles(r["text"]) for r in queries.table(spark, odd.SMALL, "benchmark").collect()]
    foul = {i for i, t in kept[3].items() if any(x and len(odd.shingles(t) & x) >= 0.8 * len(x) for x in items)}
    assert set(kept[4]) == set(kept[3]) - foul
    # tokens: the library's
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(f.read()), special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, odd.SMALL).collect()
    assert {r["doc_id"]: r["ids"] for r in last} == {i: library.encode_ordinary(t or "") for i, t in kept[4].items()}


def test_odd_and_empty_tables_pass_through(spark, tmp_path):
    odd.odd_documents(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item"), (None, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0
    docs = queries.table(spark, str(tmp_path), "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"file://{tmp_path}")
    assert docs.count() == 0


def test_what_a_table_knows_of_itself_takes_no_job(spark):
    """The driver keeps something of every job: rows are counted while they are written, and few rows are joined as they are."""
    docs = queries.table(spark, odd.SMALL, "documents")
    spark.sparkContext.setJobGroup("keep-one", "")
    try:
        kept = ngram_join.keep_one(docs).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("keep-one"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept and jobs <= 60  # 76 with a job for each count
    table, found = common.written_with(docs.select("doc_id"), "counted", F.count("*").alias("n"), F.sum("doc_id").alias("s"))
    assert found["n"] == table.count() and found["s"] == table.agg(F.sum("doc_id")).first()[0]
    table, found = common.written_with(docs.select("doc_id").limit(0), "counted", F.count("*").alias("n"))
    assert (found["n"], table.count()) == (0, 0)
