"""Streaming annotation and running counts (M1, M2)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critica.operators.aggregates import category_counts
from critica.operators.routing import route_by_text
from critica.operators.zero_shot import annotate


def stream_annotate(spark: SparkSession, source: str, schema, client, model: str, out: str,
                    checkpoint: str, fmt: str = "parquet"):
    """New review files → answers appended to ``out``; a restart resumes (M1).

    Each micro-batch removes reviews already answered by ``model`` (anti
    join on the stored answers), so a replayed batch appends nothing twice;
    progress is kept in ``checkpoint``.  Runs all available files, then stops.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)

    def per_batch(batch: DataFrame, epoch_id: int):
        # Stored answers are read through Spark (the sink may be any shared
        # file system); before the first append there is nothing to read.
        try:
            stored = batch.sparkSession.read.parquet(out)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = None
        new = annotate(batch, client, model, stored)
        new.write.mode("append").parquet(out)

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_category_counts(spark: SparkSession, source: str, schema, query_name: str,
                           fmt: str = "parquet", checkpoint: str | None = None):
    """Running per-app category counts over a stream of answered reviews (M2).

    Stateful aggregation in complete mode; the memory sink ``query_name``
    holds the current totals, equal to the batch ``category_counts``.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    counts = category_counts(route_by_text(stream), ["app"])
    w = counts.writeStream.outputMode("complete").format("memory").queryName(query_name)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q
