"""A corpus pipeline of five stages: quality rules, toxicity, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of ``docs``. ``run`` writes each stage's rows once and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import minhash, packing, quality_rules, secret_scan, toxicity
from palimpsest.llm.shared import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no quality rule rejects."""
    return quality_rules.judge(docs)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5 for toxicity."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash.keep_one(docs, width=5, percent=80)


def cover_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by their kind and n_chars as the text then is."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its place in a sequence."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", keep_good),
    ("toxicity", keep_civil),
    ("minhash near-dedup", keep_distinct),
    ("secret scan", cover_secrets),
    ("best-fit packing", pack_tokens),
]

#: Training and hashing can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
