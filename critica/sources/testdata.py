"""Adapter views that present the driver's generic tables as review tables.

The generated tables carry no review columns, so each view maps them by a
fixed rule.  Every view is written twice: as DataFrame code (what a Spark
user runs) and as SQL text for the DuckDB oracle.  Both must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread_input(df: DataFrame, bytes_per_partition: int = 1 << 20) -> DataFrame:
    """Rebalance a scan that yields too few partitions for its size.

    A single-row-group file is one task, so per-row text work would run on
    one core.  The target is the scan's estimated size / ``bytes_per_partition``
    (no job: the planner's statistics), capped at the default parallelism; a
    small table stays as it is, and inputs already split into enough
    partitions (any large table on a cluster) pass through unshuffled.
    """
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        raw = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        size = int(raw) if isinstance(raw, int) else int(raw.toString())
        have = df.rdd.getNumPartitions()
    except Exception:  # a session without RDD access (e.g. Spark Connect): leave the scan as planned
        return df
    target = max(1, min(want, -(-size // bytes_per_partition)))
    return df.repartition(target) if have < target else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_input(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("review_id"),
        F.col("source").alias("app"),
        F.col("lang").alias("ori_lang"),
        F.col("text").alias("data"),
        (F.lit(1) + F.col("doc_id") % 5).cast("int").alias("score"),
        (F.col("n_chars") % 7).cast("bigint").alias("thumbsUpCount"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return reviews(spark, sf_dir).join(
        lab.select(
            F.col("doc_id").alias("review_id"),
            F.col("toxic").cast("int").alias("irrelevant"),
            F.col("quality").cast("int").alias("feature_request"),
            (F.lit(1) - F.col("quality")).cast("int").alias("problem_report"),
        ),
        "review_id",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews with a free-text model answer in ``result``."""
    l = labelled(spark, sf_dir)
    base = F.concat_ws(
        ", ",
        F.when(F.col("problem_report") == 1, F.lit("Problem Report")),
        F.when(F.col("feature_request") == 1, F.lit("Feature Request")),
        F.when(F.col("irrelevant") == 1, F.lit("Irrelevant")),
    )
    rid = F.col("review_id")
    result = (F.when(rid % 11 == 0, F.lit(None).cast("string"))
              .when(rid % 13 == 0, F.lit("I cannot tell."))
              .when(rid % 3 == 0, F.upper(base))
              .otherwise(base))
    return l.withColumn("result", result)


def structured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews with an answer in the ``Label: value`` line form."""
    l = labelled(spark, sf_dir)
    rid = F.col("review_id")
    neg = (F.when(rid % 4 == 0, F.lit("None")).when(rid % 4 == 1, F.lit("No"))
           .when(rid % 4 == 2, F.lit("N/A")).otherwise(F.lit("Irrelevant")))
    fea = F.when(F.col("feature_request") == 1,
                 F.when(rid % 5 == 0, F.lit("add\r offline sync")).otherwise(F.lit("Add offline sync"))
                 ).otherwise(neg)
    pro = F.when(F.col("problem_report") == 1, F.lit("Crashes at start")).otherwise(neg)
    irr = F.when(F.col("irrelevant") == 1,
                 F.when(rid % 2 == 0, F.lit("Oui")).otherwise(F.lit("Yes"))).otherwise(F.lit("No"))
    text = F.concat(F.lit("Feature Request: "), fea, F.lit("\n"),
                    F.lit("Problem Report: "), pro,
                    F.when(rid % 7 == 0, F.lit("")).otherwise(F.lit("\n")),
                    F.lit("Irrelevant: "), irr, F.lit("\n"))
    text = F.when(rid % 3 == 0, F.lower(text)).otherwise(text)
    return l.withColumn("result", text)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews plus predictions ``pred_<label>``: truth with a fixed share flipped."""
    l = labelled(spark, sf_dir)
    cols = []
    for lab in ("irrelevant", "feature_request", "problem_report"):
        flip = F.substring(F.md5(F.concat_ws("-", F.col("review_id").cast("string"), F.lit(lab))), 1, 1).isin("0", "1")
        cols.append(F.when(flip, F.lit(1) - F.col(lab)).otherwise(F.col(lab)).cast("int").alias(f"pred_{lab}"))
    return l.select("*", *cols)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with an embedding vector; the vector's label is the ground-truth cluster."""
    e = table(spark, sf_dir, "embeddings")
    return reviews(spark, sf_dir).join(
        e.select(F.col("vec_id").alias("review_id"),
                 F.col("embedding").cast("array<double>").alias("embedding"),
                 F.col("label").cast("int").alias("clusters")),
        "review_id",
    )


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL (common table expressions).

REVIEWS_SQL = """reviews AS (
  SELECT doc_id AS review_id, source AS app, lang AS ori_lang, text AS data,
         CAST(1 + doc_id % 5 AS INTEGER) AS score, CAST(n_chars % 7 AS BIGINT) AS thumbsUpCount
  FROM documents)"""

LABELLED_SQL = REVIEWS_SQL + """,
labelled AS (
  SELECT r.*, CAST(l.toxic AS INTEGER) AS irrelevant, CAST(l.quality AS INTEGER) AS feature_request,
         CAST(1 - l.quality AS INTEGER) AS problem_report
  FROM reviews r JOIN labels l ON r.review_id = l.doc_id)"""

ANSWERS_SQL = LABELLED_SQL + """,
answers AS (
  SELECT *,
    CASE WHEN review_id % 11 = 0 THEN NULL
         WHEN review_id % 13 = 0 THEN 'I cannot tell.'
         WHEN review_id % 3 = 0 THEN upper(base)
         ELSE base END AS result
  FROM (SELECT *, concat_ws(', ',
          CASE WHEN problem_report = 1 THEN 'Problem Report' END,
          CASE WHEN feature_request = 1 THEN 'Feature Request' END,
          CASE WHEN irrelevant = 1 THEN 'Irrelevant' END) AS base FROM labelled) t)"""

STRUCTURED_SQL = LABELLED_SQL + """,
structured AS (
  SELECT * EXCLUDE (txt, neg), CASE WHEN review_id % 3 = 0 THEN lower(txt) ELSE txt END AS result
  FROM (
    SELECT *, 'Feature Request: ' ||
        CASE WHEN feature_request = 1 THEN
             CASE WHEN review_id % 5 = 0 THEN 'add' || chr(13) || ' offline sync' ELSE 'Add offline sync' END
             ELSE neg END || chr(10) ||
        'Problem Report: ' || CASE WHEN problem_report = 1 THEN 'Crashes at start' ELSE neg END ||
        CASE WHEN review_id % 7 = 0 THEN '' ELSE chr(10) END ||
        'Irrelevant: ' || CASE WHEN irrelevant = 1 THEN CASE WHEN review_id % 2 = 0 THEN 'Oui' ELSE 'Yes' END
                               ELSE 'No' END || chr(10) AS txt
    FROM (SELECT *, CASE review_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'No' WHEN 2 THEN 'N/A'
                         ELSE 'Irrelevant' END AS neg FROM labelled) a) b)"""


def _flip_sql(lab: str) -> str:
    return (f"CAST(CASE WHEN substr(md5(CAST(review_id AS VARCHAR) || '-{lab}'), 1, 1) IN ('0', '1') "
            f"THEN 1 - {lab} ELSE {lab} END AS INTEGER) AS pred_{lab}")


PREDICTED_SQL = LABELLED_SQL + """,
predicted AS (
  SELECT *, """ + ", ".join(_flip_sql(l) for l in ("irrelevant", "feature_request", "problem_report")) + """
  FROM labelled)"""

CLUSTERED_SQL = REVIEWS_SQL + """,
clustered AS (
  SELECT r.*, CAST(e.embedding AS DOUBLE[]) AS embedding, CAST(e.label AS INTEGER) AS clusters
  FROM reviews r JOIN embeddings e ON r.review_id = e.vec_id)"""


def with_views(sql_views: str, body: str) -> str:
    """Prefix a query body with the given view definitions."""
    return "WITH " + sql_views + "\n" + body
