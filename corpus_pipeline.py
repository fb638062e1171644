"""A training-data pipeline over ``documents``: five stages, each one operator of ``sampleyard.llm``.

Each stage takes what its predecessor kept, written as Parquet and read again.  All but the last
return the columns of documents; the last returns the token ids.  Nulls, empty and repeated rows
are handled as each operator defines; in short: rows without letters go at the first stage,
repeated rows at the third, an empty table stays empty throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleyard.llm import byte_bpe, decontamination, language_id, ngram_join, queries, toxicity
from sampleyard.llm.common import digested, is_fold, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose two likeliest languages cannot be told apart."""
    model = language_id.fit(docs, learn=~is_fold(F.col("doc_id"), 3, 1))
    return language_id.accepted(docs, model)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more; learns from labels outside the held-out fold."""
    labels = queries.table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull()).select("doc_id", "toxic")
    known = digested(docs.where(~is_fold(F.col("doc_id"), 4, 2)).select("doc_id", "text")).join(labels, "doc_id")
    return toxicity.clean(docs, toxicity.fit(known))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word Jaccard similarity of 0.8 or more stays."""
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 or more of a benchmark item's shingles."""
    return decontamination.uncontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): byte-level BPE ids and the check of their round trip."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return byte_bpe.digests(decoded, keep=["ids"])


STAGES = [
    ("language ID", identify_language),
    ("toxicity", remove_toxic),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: Compression, learned scores and a vocabulary are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = queries.table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"stage-{at + 1}")
    return docs
