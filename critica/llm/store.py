"""Intermediate tables written once to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from critica.session import run_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder below ``spark.checkpoint.dir``."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet and reread.

    Several branches then read one result, a lost executor costs no
    recomputation of the steps before, and the lineage ends here.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
