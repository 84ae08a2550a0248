"""Corpus pipeline: documents → tokens, one operator a stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept; all but the last return the columns of ``documents``. The last returns
the token digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm import bpe, decontaminate, jaccard_join, pii, quality
from verdant.llm.common import prepare, stored


NEAR = jaccard_join.Likeness(width=5, num=80, den=100)       # near copies; op3's query has its own contract


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (operator 9), trained here: junk and toxic documents go."""
    model = quality.train(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    judged = quality.judge(docs, model)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)      # its last column, whatever ``docs`` has


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (operator 3) on shingles of five words, similar from 0.8
    on: the smallest doc_id of each component stays."""
    return jaccard_join.keep_one(docs, NEAR)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 8): documents that overlap an item go."""
    return decontaminate.clean(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (operator 1): spans become their kind; n_chars follows."""
    return pii.mask(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE encoding and decoding (operator 4)."""
    import public_tokenizers
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontamination", drop_benchmark),
          ("pii", mask_personal_data), ("bpe", tokenise)]

# Trained models and merges are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    prepare(spark)
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
