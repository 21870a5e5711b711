"""Registered queries of the smaller operators (projections, filters, sets, splits, report records)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.functions import text as TX
from critica.functions import vectors as V
from critica.operators import aggregates as AG
from critica.operators import cluster as C
from critica.operators import joins as J
from critica.operators import metrics as M
from critica.operators import routing as RT
from critica.operators import split as SP
from critica.operators.ranking import distributed_rank
from critica.plans import analyze as AN
from critica.plans.catalog_eval import _report_sql
from critica.plans.registry import r6, register
from critica.sources import testdata as TD

LABELS = ["irrelevant", "feature_request", "problem_report"]


@register("project", TD.with_views(TD.REVIEWS_SQL, "SELECT review_id, app, score FROM reviews"))
def q_project(spark, sf):
    return RT.project(TD.reviews(spark, sf), ["review_id", "app", "score"])


@register("filter_label", TD.with_views(TD.LABELLED_SQL, "SELECT review_id, app FROM labelled WHERE feature_request = 1"))
def q_filter_label(spark, sf):
    return RT.filter_label(TD.labelled(spark, sf), "feature_request").select("review_id", "app")


@register("cluster_members", TD.with_views(TD.CLUSTERED_SQL, "SELECT review_id, clusters FROM clustered WHERE clusters = 1"))
def q_cluster_members(spark, sf):
    return RT.cluster_members(TD.clustered(spark, sf), 1).select("review_id", "clusters")


@register("split_noise", TD.with_views(TD.CLUSTERED_SQL, """
SELECT review_id, c AS clusters, c = -1 AS is_noise
FROM (SELECT review_id, CASE WHEN review_id % 4 = 0 THEN -1 ELSE clusters END AS c FROM clustered) t"""))
def q_split_noise(spark, sf):
    c = TD.clustered(spark, sf).withColumn("clusters", F.when(F.col("review_id") % 4 == 0, -1).otherwise(F.col("clusters")))
    return RT.split_noise(c).select("review_id", "clusters", "is_noise")


@register("coerce_text", TD.with_views(TD.ANSWERS_SQL, """
SELECT review_id, coalesce(result, '') AS result, result IS NULL AS result_missing FROM answers"""))
def q_coerce_text(spark, sf):
    return RT.coerce_text(TD.answers(spark, sf), "result").select("review_id", "result", "result_missing")


@register("drop_null_key", TD.with_views(TD.ANSWERS_SQL, "SELECT review_id, result FROM answers WHERE result IS NOT NULL"))
def q_drop_null_key(spark, sf):
    return RT.drop_null_key(TD.answers(spark, sf), "result").select("review_id", "result")


@register("ensure_columns", TD.with_views(TD.REVIEWS_SQL, """
SELECT review_id, score, CAST(NULL AS VARCHAR) AS reply, 'app' AS store FROM reviews"""))
def q_ensure_columns(spark, sf):
    want = T.StructType([T.StructField("score", T.IntegerType()), T.StructField("reply", T.StringType()),
                         T.StructField("store", T.StringType())])
    return RT.ensure_columns(TD.reviews(spark, sf), want, {"store": "app"}).select("review_id", "score", "reply", "store")


@register("min_words", TD.with_views(TD.REVIEWS_SQL, """
SELECT review_id FROM reviews
WHERE len(regexp_extract_all(data, '[^\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+')) >= 100"""))
def q_min_words(spark, sf):
    return RT.min_words(TD.reviews(spark, sf), "data", 100).select("review_id")


@register("attach_predictions", TD.with_views(TD.PREDICTED_SQL, """
SELECT review_id, app, irrelevant, pred_irrelevant FROM predicted WHERE review_id % 3 > 0"""))
def q_attach_predictions(spark, sf):
    preds = TD.predicted(spark, sf).where(F.col("review_id") % 3 > 0).select("review_id", "pred_irrelevant")
    return J.attach_predictions(TD.labelled(spark, sf), preds).select("review_id", "app", "irrelevant", "pred_irrelevant")


@register("distinct_values", TD.with_views(TD.REVIEWS_SQL, "SELECT DISTINCT app FROM reviews"))
def q_distinct_values(spark, sf):
    return AG.distinct_values(TD.reviews(spark, sf), "app")


@register("sorted_prefixes", TD.with_views(TD.REVIEWS_SQL, """
SELECT array_to_string(list_sort(list(DISTINCT string_split(app || ' ' || ori_lang, ' ')[1])), ' ') AS prefixes FROM reviews"""))
def q_sorted_prefixes(spark, sf):
    r = TD.reviews(spark, sf).withColumn("name", F.concat_ws(" ", "app", "ori_lang"))
    return AG.sorted_prefixes(r, "name").select(F.array_join("prefixes", " ").alias("prefixes"))


@register("fit_all_split", TD.with_views(TD.LABELLED_SQL, "SELECT review_id, 'train' AS split FROM labelled"))
def q_fit_all_split(spark, sf):
    l = TD.labelled(spark, sf).withColumn("dataset", F.col("ori_lang"))
    return SP.stratified_split(l, LABELS, 0.2, fit_all=True).select("review_id", "split")


@register("repeat_runs", TD.with_views(TD.LABELLED_SQL, """
SELECT review_id, run_seed, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_valid THEN 'valid' ELSE 'train' END AS split
FROM (
  SELECT *, CASE WHEN n <= 1 THEN 0 ELSE floor(CAST(0.25 AS DOUBLE) / (CAST(1.0 AS DOUBLE) - CAST(0.2 AS DOUBLE)) * (n - n_test) + 0.5) END AS n_valid
  FROM (
    SELECT *, CASE WHEN n <= 1 THEN 0 ELSE floor(CAST(0.2 AS DOUBLE) * n + 0.5) END AS n_test
    FROM (
      SELECT review_id, run_seed,
        count(*) OVER (PARTITION BY run_seed, ori_lang, irrelevant, feature_request, problem_report) AS n,
        row_number() OVER (PARTITION BY run_seed, ori_lang, irrelevant, feature_request, problem_report
                           ORDER BY md5(CAST(review_id AS VARCHAR) || '-' || CAST(run_seed AS VARCHAR)), review_id) AS rn
      FROM labelled, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS run_seed) seeds) a) b) c"""))
def q_repeat_runs(spark, sf):
    l = TD.labelled(spark, sf).withColumn("dataset", F.col("ori_lang"))
    return SP.repeat_runs(l, LABELS, 0.2, 0.25, [1, 2, 3]).select("review_id", "run_seed", "split")


@register("app_slug", TD.with_views(TD.REVIEWS_SQL, """
SELECT DISTINCT app, replace(app || ' ' || ori_lang, ' ', '-') AS slug FROM reviews"""))
def q_app_slug(spark, sf):
    return TD.reviews(spark, sf).select("app", TX.app_slug(F.concat_ws(" ", "app", "ori_lang")).alias("slug")).distinct()


@register("sigmoid", TD.with_views(TD.REVIEWS_SQL, """
SELECT review_id, round(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-CAST(score - 3 AS DOUBLE))), 6) AS p FROM reviews"""))
def q_sigmoid(spark, sf):
    return TD.reviews(spark, sf).select("review_id", r6(V.sigmoid((F.col("score") - 3).cast("double"))).alias("p"))


@register("document_round_trip", TD.with_views(TD.REVIEWS_SQL, """
SELECT app, ori_lang, md5(trim(data)) AS review, CAST(count(*) AS BIGINT) AS n FROM reviews WHERE length(trim(data)) > 0
GROUP BY app, ori_lang, md5(trim(data))"""))
def q_document_round_trip(spark, sf):
    """Every review text comes back out of its group's joined documents."""
    docs = AG.cluster_documents(TD.reviews(spark, sf).where(F.length(F.trim("data")) > 0), ["app", "ori_lang"], min_size=1)
    parts = docs.select("app", "ori_lang", F.explode(TX.split_document("document")).alias("text"))
    return parts.groupBy("app", "ori_lang", F.md5(F.trim("text")).alias("review")).agg(F.count(F.lit(1)).alias("n"))


# Prim's rule, all groups side by side: a step takes each group's outside point with the lightest edge inwards.
_FOREST_SQL = "WITH RECURSIVE " + TD.CLUSTERED_SQL + """,
pts AS (SELECT ori_lang AS g, review_id AS id, embedding AS v FROM clustered),
step AS (
  SELECT 0 AS k, g, id, v, list_distance(v, first_value(v) OVER s) AS w, first_value(id) OVER s AS src,
         id = first_value(id) OVER s AS inside, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS d
  FROM pts WINDOW s AS (PARTITION BY g ORDER BY id)
  UNION ALL
  SELECT k + 1, g, id, v, CASE WHEN nearer THEN dist ELSE w END, CASE WHEN nearer THEN p.id ELSE src END,
         inside OR id = p.id, p.src, p.id, p.w
  FROM (SELECT *, list_distance(v, p.v) AS dist, list_distance(v, p.v) < w AS nearer
        FROM (SELECT *, first_value(struct_pack(id := id, src := src, w := w, v := v, inside := inside))
                        OVER (PARTITION BY g ORDER BY inside, w, least(src, id), greatest(src, id)) AS p FROM step))
  WHERE NOT p.inside)"""


@register("spanning_forest", _FOREST_SQL + """
SELECT DISTINCT g AS ori_lang, least(a, b) AS lo, greatest(a, b) AS hi, round(d, 6) AS w FROM step WHERE k > 0""")
def q_spanning_forest(spark, sf):
    """Edges and weights of every group's minimum spanning tree."""
    return C.minimum_spanning_forest(TD.clustered(spark, sf), ["ori_lang"]).select("ori_lang", "lo", "hi", r6("w").alias("w"))


def _tables(spark, sf):
    """Counts, clusters and reviews of a report over the given clusters."""
    c = TD.clustered(spark, sf).withColumn("category", F.lit("pro")).select(
        F.col("ori_lang").alias("app"), "category", "clusters", "review_id", "data", "score", "thumbsUpCount")
    keys = ["app", "category", "clusters"]
    imp = AG.cluster_importance(c, ["app", "category"])
    clusters = imp.select(*keys, F.col("clusters").alias("cluster_rank"), F.concat_ws(" ", F.lit("cluster"), "clusters").alias("summary"),
                          F.round("importance", 6).alias("importance"), F.col("n").alias("count"))
    reviews = c.select(*keys, F.col("review_id").alias("review_rank"), F.md5("data").alias("data"))
    counts = c.groupBy("app").agg(F.count(F.lit(1)).alias("n_reviews"), F.count(F.lit(1)).alias("n_problem_report"),
                                  F.lit(0).cast("bigint").alias("n_feature_request"), F.lit(0).cast("bigint").alias("n_irrelevant"))
    return counts, clusters, reviews


_FLAT_SQL = TD.with_views(TD.CLUSTERED_SQL, """
SELECT ori_lang AS app, 'problem_report' AS category,
  CAST(dense_rank() OVER (PARTITION BY ori_lang ORDER BY clusters) - 1 AS INTEGER) AS cluster_pos,
  'cluster ' || clusters AS summary, CAST(count(*) OVER (PARTITION BY ori_lang, clusters) AS BIGINT) AS count,
  CAST(row_number() OVER (PARTITION BY ori_lang, clusters ORDER BY review_id) - 1 AS INTEGER) AS review_pos,
  md5(data) AS review, ori_lang AS app_slug
FROM clustered WHERE clusters >= 0""")


def _parts(spark, sf):
    """Report records of at most 50 reviews, with ranks that are positions."""
    counts, clusters, reviews = _tables(spark, sf)
    keys = ["app", "category", "clusters"]
    clusters = distributed_rank(clusters.drop("cluster_rank"), ["app", "category"], ["clusters"], "cluster_rank")
    reviews = distributed_rank(reviews.withColumnRenamed("review_rank", "_id"), keys, ["_id"], "review_rank").drop("_id")
    return AN.report_parts(clusters, reviews, 50)


@register("report_records", _FLAT_SQL)
def q_report_records(spark, sf):
    flat = AN.flatten_parts(_parts(spark, sf), 50)
    return flat.select("app", "category", "cluster_pos", "summary", "count", "review_pos", "review", "app_slug")


@register("report_json", _FLAT_SQL)
def q_report_json(spark, sf):
    """The records as JSON texts, one a part, and back."""
    text = AN.parts_to_json(_parts(spark, sf))
    flat = AN.flatten_parts(AN.parts_from_json(text), 50)
    return flat.select("app", "category", "cluster_pos", "summary", "count", "review_pos", "review", "app_slug")


_METRIC_ROWS = ("feature_request", "problem_report", "irrelevant", "weighted avg")


@register("metrics_table", TD.with_views(TD.PREDICTED_SQL + ",\n" + _report_sql("predicted", ["ori_lang"]), """
SELECT ori_lang AS experiment, """ + ", ".join(
    f"max(round({c}, 3)) FILTER (row_name = '{r}') AS \"{r}_{s}\"" for r in _METRIC_ROWS
    for c, s in (("precision", "p"), ("recall", "r"), ("f1", "f"))) + " FROM rep GROUP BY ori_lang"))
def q_metrics_table(spark, sf):
    """One row per experiment with the three figures of every class row."""
    rep = M.classification_report(TD.predicted(spark, sf).withColumnRenamed("ori_lang", "experiment"), LABELS, keys=["experiment"])
    return M.metrics_table(rep)
