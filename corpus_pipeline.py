"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs, so lineage ends at every stage and a lost executor repeats one stage
at most. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import default_tokenizer, encode_decode
from quillon.llm.common import delete, shared_dir, staging
from quillon.llm.decontaminate import find_leaks
from quillon.llm.line_dedup import line_dedup
from quillon.llm.near_dedup import simhash_dedup
from quillon.llm.toxicity import contract_model, toxicity
from quillon.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field scores at one half or more go."""
    scored = toxicity(docs, contract_model(docs, spark, sf_dir), out="__toxicity", spans=False)
    return scored.where(F.col("__toxicity.score") < 0.5).drop("__toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or place has go; n_chars follows. Every document stays."""
    return line_dedup(docs, count_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of five-word shingles, found by SimHash, the one with the smallest id stays."""
    return simhash_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), out="__leaks").where(F.size("__leaks") == 0).drop("__leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids and decoded_sha256 of every text."""
    return encode_decode(docs, default_tokenizer(), fields=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: No SQL: the stages train a model, follow links to a fixpoint and merge byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/quillon/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
