"""Declared schemas of the review data model.

Reads never infer a schema; optional columns are added as typed nulls by
``ensure_columns``.
"""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = ["irrelevant", "feature_request", "problem_report"]
CATEGORIES = {"feature_request": "fea", "problem_report": "pro", "irrelevant": "irr"}

REVIEW = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("app", T.StringType()),
    T.StructField("ori_lang", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("thumbsUpCount", T.LongType()),
    T.StructField("irrelevant", T.IntegerType()),
    T.StructField("feature_request", T.IntegerType()),
    T.StructField("problem_report", T.IntegerType()),
    T.StructField("ground_truth", T.IntegerType()),
    T.StructField("result", T.StringType()),
])

# Column layout of a labelled review CSV as written by annotators; no key column.
REVIEW_CSV = T.StructType([
    T.StructField("data", T.StringType()),
    T.StructField("ground_truth", T.IntegerType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("thumbsUpCount", T.LongType()),
    T.StructField("problem_report", T.IntegerType()),
    T.StructField("feature_request", T.IntegerType()),
    T.StructField("irrelevant", T.IntegerType()),
    T.StructField("ori_lang", T.StringType()),
    T.StructField("app", T.StringType()),
])

RESPONSE_CSV = T.StructType(REVIEW_CSV.fields + [T.StructField("result", T.StringType())])

CLUSTERED_CSV = T.StructType([
    T.StructField("data", T.StringType()),
    T.StructField("ground_truth", T.IntegerType()),
    T.StructField("clusters", T.IntegerType()),
    T.StructField("ori_lang", T.StringType()),
    T.StructField("app", T.StringType()),
])

EMBEDDED = T.StructType(REVIEW_CSV.fields + [
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("20_dim_embedding", T.ArrayType(T.DoubleType())),
    T.StructField("2_dim_embedding", T.ArrayType(T.DoubleType())),
])

METRICS = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("eval_set", T.StringType()),
    T.StructField("ori_lang", T.StringType()),
    T.StructField("row_name", T.StringType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("support", T.LongType()),
])

CLUSTER_ENTRY = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("importance", T.DoubleType()),
    T.StructField("count", T.LongType()),
    T.StructField("reviews", T.ArrayType(T.StringType())),
])

CATEGORY_BLOCK = T.StructType([
    T.StructField("count", T.LongType()),
    T.StructField("clusters", T.ArrayType(CLUSTER_ENTRY)),
])

REPORT = T.StructType([
    T.StructField("app", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("problem_report", CATEGORY_BLOCK),
    T.StructField("feature_request", CATEGORY_BLOCK),
    T.StructField("irrelevant", T.StructType([T.StructField("count", T.LongType())])),
])
