"""Plan shape of every registered query, and of every intermediate table that it
writes on the way: no cartesian or nested-loop joins, no single-partition exchange
(an unpartitioned window or global sort), and no row-at-a-time Python UDF."""
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from critica.plans import catalog

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython"]


# Model-fitting queries (Spark ML estimators) are left out: fitting runs
# during plan construction and their plans are the library's.
MODEL_FITTING = {"nb_predict", "svc_predict", "kernel_svc_predict", "sgd_hinge_predict", "rf_predict", "lr_head_predict",
                 "reduce_dimension", "encode_word2vec", "embed_corpus", "detect_language_nb"}
# One value for the whole table, added up in the tasks first.
GLOBAL_AGGREGATES = {"sorted_prefixes"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - MODEL_FITTING - GLOBAL_AGGREGATES))
def test_plan_shape(spark, name, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def recorded(writer, path, *args, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans.append(catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for plan in plans:
        assert not [f for f in FORBIDDEN if f in plan], plan[:3000]
