"""The registered queries of the corpus operators: thin wrappers that read a table and call an operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, decontamination, duck, embedding_dedup, html_extraction, language_id, ngram_join, phrases, quality, sentence_pieces, sharding, token_files, toxicity
from .common import digested, is_fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def _labelled(spark: SparkSession, sf_dir: str, label: str, parts: int, held: int) -> DataFrame:
    """Texts and labels outside the held-out fold."""
    docs = digested(table(spark, sf_dir, "documents").where(~is_fold(F.col("doc_id"), parts, held)).select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").where(F.col(label).isNotNull()).select("doc_id", label)
    return docs.join(labels, "doc_id").drop("doc_id")


def _held(scored: DataFrame, parts: int, held: int) -> DataFrame:
    first = scored.columns[0]
    return scored.select(first, is_fold(F.col(first), parts, held).alias("held_out"), *scored.columns[1:])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.fit(_labelled(spark, sf_dir, "quality", 3, 1))
    return _held(quality.score(table(spark, sf_dir, "documents"), model), 3, 1)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(_labelled(spark, sf_dir, "toxic", 4, 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return _held(scored, 4, 2).withColumn("n_offending", F.size("offending"))


def language_model(spark: SparkSession, sf_dir: str) -> language_id.LanguageModel:
    docs = table(spark, sf_dir, "documents")
    return language_id.fit(docs, learn=~is_fold(F.col("doc_id"), 3, 1))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(language_id.identify(table(spark, sf_dir, "documents"), language_model(spark, sf_dir)), 3, 1)


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_digests(index)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.digests(sentence_pieces.encode(table(spark, sf_dir, "documents"), model), model)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": duck.contaminated(),
        "op3_ngram_join": duck.jaccard_join(),
        "op4_embedding_dedup": duck.near_duplicates(),
        "op12_centroids": duck.centroids(),
        "op13_phrases": duck.phrases(),
    }
