"""A training-data pipeline over documents: quality rules, near copies, repeated passages, test leaks, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.

All stages but the last keep every column of docs under its own name, whatever that is, and all give an empty table for an empty
one. Texts of any length are read whole. Null and empty texts fail the base rules and go in the first stage; given to a later one, they are
near copies of each other for near_dedup, stay as they are in the two cutting stages, and are packed as empty texts. Rows that
repeat a doc_id are judged row by row, except that near_dedup keeps one of them, and substring_dedup takes from none what only
rows of its own doc_id hold. Rows without a doc_id stay in near_dedup and count as the latest in substring_dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, packing, quality, simhash, substring
from spanlake.llm.common import written


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond their group's thresholds go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document of which nothing is left goes."""
    return _recounted(substring.deduplicated(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the test items are cut; a document of which nothing is left goes."""
    return _recounted(decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]

#: The last stage needs a tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
