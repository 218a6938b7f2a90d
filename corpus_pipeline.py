"""A training-corpus pipeline over ``documents``.

Stages, each over all rows that its predecessor kept (columns beside those of ``documents`` are kept, whatever their names; an empty
table gives an empty one), each result written as Parquet and read again:
  quality     quality rules reject documents,
  near_dedup  one document of each near-duplicate group stays,
  secrets     spans of secrets are replaced by a mark,
  mix         sources are mixed to their target weights (documents repeat or go),
  tokens      byte-level BPE ids of what is left, and digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import byte_bpe, quality_rules, secret_scan, simhash, source_mix
from weftgraph.llm.shared import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the quality rules. Null, empty and short texts go; null lang and source are values like others;
    repeated rows are judged alike, and all of them stay or go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id (null is the largest). Null and empty texts
    are one group; of repeated rows one stays."""
    return simhash.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its secrets replaced by a mark and n_chars made new. Null texts stay null."""
    return secret_scan.without_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. Null and empty texts have no words and are not taken; rows that repeat a doc_id share
    what is taken of them; a null source is a source."""
    return source_mix.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each row the number of byte-level BPE ids and digests of ids and decoded text. A null text counts as empty."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: The quality stage iterates to robust estimates and near_dedup to components, which SQL does not express; the tests
#: hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")
