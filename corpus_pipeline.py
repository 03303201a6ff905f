"""A corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Between stages
``run`` writes a table to the shared folder and reads it again, which cuts the lineage, and removes the one before;
the last one stays until ``lenscube.llm.common.release``.

Null texts count as empty (and stay null until packing), null ids are rows of their own, rows that repeat a doc_id are
judged each by itself but for near-duplicates, where one of them stays; an empty table gives no rows; texts of any
length are taken whole; columns beyond those of ``documents``, of whatever name, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenscube.llm import decontamination, packing, quality, secrets, simhash
from lenscube.llm.common import kept, load, release, scratch
from lenscube.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest doc_id stays."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    columns = docs.columns
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed sequences."""
    return packing.digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mine = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        others = kept() - {mine}
        path = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs, mine = spark.read.parquet(path), path
        release(spark, others | {mine})  # the stage before, and what this one's operator kept
    return STAGES[-1][1](spark, docs, sf_dir)
