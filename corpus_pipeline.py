"""Documents to packed training sequences, in stages that each read what the previous one wrote.

Rejected documents leave in the first stage; lines that many documents share are cut from all of them; of each group of near
duplicates one document stays; secrets are replaced in the texts; what is left is tokenised and packed. All stages but the last return
the columns of ``documents``, and ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import line_dedup, minhash_dedup, packing, quality_rules, secret_scan
from factorloom.llm.shared import stored

CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs, policy="v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_shared_lines(docs, min_documents=10, min_points=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.representatives(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=CAPACITY)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("packing", packed),
]

#: Token ids cannot be stated in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each over the stored rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
