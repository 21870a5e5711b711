"""Corpus pipeline: quality rules, line deduplication, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes every
stage's result as Parquet below ``spark.checkpoint.dir`` and reads it
again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critica.llm import line_templates, near_dup, packing, quality_rules
from critica.llm.store import written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table (operator 8)."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines (operator 3); a document whose lines have all gone goes too."""
    out = line_templates.drop_recurring(docs)
    gone = (F.col("n_dropped") > 0) & (F.col("n_dropped") >= F.col("n_lines"))
    out = out.where(~gone).withColumn("n_chars", F.when(
        F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 6)."""
    return near_dup.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024 (operator 1)."""
    return packing.packed_documents(docs, TOKENIZER, end_id=2, capacity=1024)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("packing", pack)]

#: Tokenisation and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
