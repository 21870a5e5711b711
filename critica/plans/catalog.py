"""Registered queries over the driver's tables, each with a DuckDB oracle.

Every query reads whole tables through the adapter views of
``critica.sources.testdata`` and runs the library operators on them; the
oracle SQL states the same result independently.  Computed columns carry
the same alias on both sides; floating results are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critica.functions import text as TX
from critica.functions import vectors as V
from critica.functions.language import detect_language
from critica.plans.sql_twins import detect_language_sql
from critica.operators import aggregates as AG
from critica.operators import joins as J
from critica.operators import metrics as M
from critica.operators import ranking as R
from critica.operators import routing as RT
from critica.operators import split as SP
from critica.schema import LABELS
from critica.sources import testdata as TD

from critica.plans.registry import ORACLE, QUERIES, r6, register  # noqa: E402,F401


# --------------------------------------------------------------------------
# Routing and counts

@register("route_by_text", TD.with_views(TD.ANSWERS_SQL, """
SELECT review_id, app,
  coalesce(contains(lower(result), 'feature request'), false) AS is_fea,
  coalesce(contains(lower(result), 'problem report'), false) AS is_pro,
  coalesce(contains(lower(result), 'irrelevant'), false) AS is_irr
FROM answers"""))
def q_route_by_text(spark: SparkSession, sf: str) -> DataFrame:
    return RT.route_by_text(TD.answers(spark, sf)).select("review_id", "app", "is_fea", "is_pro", "is_irr")


@register("route_long", TD.with_views(TD.ANSWERS_SQL, """
SELECT review_id, category FROM (
  SELECT review_id, 'fea' AS category FROM answers WHERE contains(lower(result), 'feature request')
  UNION ALL SELECT review_id, 'pro' FROM answers WHERE contains(lower(result), 'problem report')
  UNION ALL SELECT review_id, 'irr' FROM answers WHERE contains(lower(result), 'irrelevant')) t"""))
def q_route_long(spark, sf):
    return RT.route_long(TD.answers(spark, sf))


@register("category_counts", TD.with_views(TD.ANSWERS_SQL, """
SELECT app, CAST(count(*) AS BIGINT) AS n_reviews,
  CAST(sum(CASE WHEN contains(lower(result), 'feature request') THEN 1 ELSE 0 END) AS BIGINT) AS n_feature_request,
  CAST(sum(CASE WHEN contains(lower(result), 'problem report') THEN 1 ELSE 0 END) AS BIGINT) AS n_problem_report,
  CAST(sum(CASE WHEN contains(lower(result), 'irrelevant') THEN 1 ELSE 0 END) AS BIGINT) AS n_irrelevant,
  CAST(sum(CASE WHEN coalesce(contains(lower(result), 'feature request') OR contains(lower(result), 'problem report')
                 OR contains(lower(result), 'irrelevant'), false) THEN 0 ELSE 1 END) AS BIGINT) AS n_unrouted
FROM answers GROUP BY app"""))
def q_category_counts(spark, sf):
    return AG.category_counts(RT.route_by_text(TD.answers(spark, sf)))


def _answer_sql(col: str, label: str) -> str:
    return (f"CAST(len(list_filter(regexp_extract_all(lower({col}), '{label}: ([^\\n]*)\\n', 1), "
            "lambda x: NOT (starts_with(x, 'no') OR starts_with(x, 'irrelevant') OR starts_with(x, 'n/a')))) > 0 "
            "AS INTEGER)")


@register("parse_structured_answer", TD.with_views(TD.STRUCTURED_SQL, f"""
SELECT review_id,
  CAST(regexp_matches(result, '(?i)irrelevant: (yes|oui|irrelevant)') AS INTEGER) AS pred_irrelevant,
  {_answer_sql('result', 'feature request')} AS pred_feature_request,
  {_answer_sql('result', 'problem report')} AS pred_problem_report,
  regexp_extract(result, 'Feature Request:(.{{12,}}|yes)\\n', 1) AS request_text
FROM structured"""))
def q_parse_structured_answer(spark, sf):
    df = RT.parse_structured_answer(TD.structured_answers(spark, sf))
    return df.select("review_id", "pred_irrelevant", "pred_feature_request", "pred_problem_report",
                     TX.extract_request_text("result").alias("request_text"))


# --------------------------------------------------------------------------
# Label tables

@register("label_distribution", TD.with_views(TD.LABELLED_SQL, """
SELECT app, ori_lang, CAST(count(*) AS BIGINT) AS total,
  CAST(sum(irrelevant) AS BIGINT) AS irrelevant, CAST(sum(feature_request) AS BIGINT) AS feature_request,
  CAST(sum(problem_report) AS BIGINT) AS problem_report
FROM labelled GROUP BY app, ori_lang"""))
def q_label_distribution(spark, sf):
    return AG.label_distribution(TD.labelled(spark, sf), LABELS)


@register("filter_language", TD.with_views(TD.LABELLED_SQL, """
SELECT review_id, app, score FROM labelled WHERE ori_lang = 'fr'"""))
def q_filter_language(spark, sf):
    return RT.filter_language(TD.labelled(spark, sf), "fr").select("review_id", "app", "score")


@register("threshold_labels", TD.with_views(TD.REVIEWS_SQL, """
SELECT review_id, CAST(CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS pred_p, round(p, 6) AS p
FROM (SELECT review_id, CAST((review_id * 37) % 101 AS DOUBLE) / 100.0 AS p FROM reviews) t"""))
def q_threshold_labels(spark, sf):
    r = TD.reviews(spark, sf).select("review_id", ((F.col("review_id") * 37) % 101).cast("double")
                                     .__truediv__(100.0).alias("p"))
    return RT.threshold_labels(r, ["p"]).select("review_id", "pred_p", r6("p").alias("p"))


@register("language_name", TD.with_views(TD.REVIEWS_SQL, f"""
SELECT review_id, coalesce(CASE ori_lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' END,
   CASE {detect_language_sql('data')} WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
        WHEN 'es' THEN 'Spanish' ELSE 'English' END) AS lang_name
FROM reviews"""))
def q_language_name(spark, sf):
    return RT.language_name(TD.reviews(spark, sf)).select("review_id", "lang_name")


@register("detect_language", TD.with_views(TD.REVIEWS_SQL, f"""
SELECT review_id, ori_lang, {detect_language_sql('data')} AS detected FROM reviews"""))
def q_detect_language(spark, sf):
    r = TD.reviews(spark, sf)
    return r.select("review_id", "ori_lang", detect_language(F.col("data")).alias("detected"))


# --------------------------------------------------------------------------
# Clusters: importance, ranking, counts

@register("cluster_importance", TD.with_views(TD.CLUSTERED_SQL, """
SELECT ori_lang, clusters, CAST(count(*) AS BIGINT) AS n,
  round((count(*) + CAST(0.1 AS DOUBLE) * coalesce(sum(thumbsUpCount), 0)) / nullif(avg(score), 0), 6) AS importance
FROM clustered WHERE clusters >= 0 GROUP BY ori_lang, clusters"""))
def q_cluster_importance(spark, sf):
    imp = AG.cluster_importance(TD.clustered(spark, sf), keys=("ori_lang",))
    return imp.select("ori_lang", "clusters", "n", r6("importance").alias("importance"))


@register("rank_clusters", TD.with_views(TD.CLUSTERED_SQL, """
SELECT ori_lang, clusters, round(importance, 6) AS importance,
  CAST(row_number() OVER (PARTITION BY ori_lang ORDER BY importance DESC NULLS LAST, clusters) AS INTEGER) AS cluster_rank
FROM (SELECT ori_lang, clusters,
        (count(*) + CAST(0.1 AS DOUBLE) * coalesce(sum(thumbsUpCount), 0)) / nullif(avg(score), 0) AS importance
      FROM clustered WHERE clusters >= 0 GROUP BY ori_lang, clusters) t"""))
def q_rank_clusters(spark, sf):
    imp = AG.cluster_importance(TD.clustered(spark, sf), keys=("ori_lang",))
    return R.rank_clusters(imp, keys=("ori_lang",)).select(
        "ori_lang", "clusters", r6("importance").alias("importance"), "cluster_rank")


@register("topk_clusters", TD.with_views(TD.CLUSTERED_SQL, """
SELECT * FROM (
  SELECT ori_lang, clusters, round(importance, 6) AS importance,
    CAST(row_number() OVER (PARTITION BY ori_lang ORDER BY importance DESC NULLS LAST, clusters) AS INTEGER) AS cluster_rank
  FROM (SELECT ori_lang, clusters,
          (count(*) + CAST(0.1 AS DOUBLE) * coalesce(sum(thumbsUpCount), 0)) / nullif(avg(score), 0) AS importance
        FROM clustered WHERE clusters >= 0 GROUP BY ori_lang, clusters) t) u
WHERE cluster_rank <= 3"""))
def q_topk_clusters(spark, sf):
    imp = AG.cluster_importance(TD.clustered(spark, sf), keys=("ori_lang",))
    top = R.top_k(imp, ["ori_lang"], [F.desc_nulls_last("importance"), F.col("clusters")], 3, "cluster_rank")
    return top.select("ori_lang", "clusters", r6("importance").alias("importance"),
                      F.col("cluster_rank").cast("int").alias("cluster_rank"))


@register("cluster_count", TD.with_views(TD.CLUSTERED_SQL, """
SELECT ori_lang, CAST(greatest(coalesce(max(clusters), -1) + 1, 0) AS INTEGER) AS n_clusters
FROM clustered GROUP BY ori_lang"""))
def q_cluster_count(spark, sf):
    return AG.cluster_count(TD.clustered(spark, sf), keys=("ori_lang",))


@register("cluster_size_stats", TD.with_views(TD.CLUSTERED_SQL, """
SELECT app, CAST(count(*) AS BIGINT) AS n_clusters, CAST(sum(CASE WHEN c >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_large,
  CAST(sum(CASE WHEN c >= 3 THEN c ELSE 0 END) AS BIGINT) AS n_in_large
FROM (SELECT app, clusters, count(*) AS c FROM clustered GROUP BY app, clusters) t GROUP BY app"""))
def q_cluster_size_stats(spark, sf):
    return AG.cluster_size_stats(TD.clustered(spark, sf), keys=("app",), cluster_col="clusters", n=3)


# --------------------------------------------------------------------------
# Large groups, documents, pending

@register("large_groups", TD.with_views(TD.CLUSTERED_SQL, """
SELECT review_id, app, clusters FROM clustered c
WHERE (SELECT count(*) FROM clustered d WHERE d.app = c.app AND d.clusters = c.clusters) >= 3"""))
def q_large_groups(spark, sf):
    return RT.keep_large_groups(TD.clustered(spark, sf), ["app", "clusters"], 3).select("review_id", "app", "clusters")


@register("large_groups_semi", TD.with_views(TD.CLUSTERED_SQL, """
SELECT review_id, ori_lang, clusters FROM clustered
WHERE (ori_lang, clusters) IN (SELECT ori_lang, clusters FROM clustered GROUP BY ori_lang, clusters HAVING count(*) >= 5)"""))
def q_large_groups_semi(spark, sf):
    return J.semi_join_large(TD.clustered(spark, sf), ["ori_lang", "clusters"], 5).select(
        "review_id", "ori_lang", "clusters")


PART_ITEMS = 4


@register("cluster_documents", TD.with_views(TD.CLUSTERED_SQL, f"""
SELECT app, clusters, part, n, md5(string_agg(data, ' ||||| ' ORDER BY review_id)) AS document_md5,
  CAST(sum(length(data)) + 7 * (count(*) - 1) AS BIGINT) AS document_chars
FROM (SELECT *, CAST(count(*) OVER (PARTITION BY app, clusters) AS BIGINT) AS n,
        CAST(floor((row_number() OVER (PARTITION BY app, clusters ORDER BY review_id) - 1) / {PART_ITEMS}) AS INTEGER) AS part
      FROM clustered) t
WHERE n >= 3 GROUP BY app, clusters, part, n"""))
def q_cluster_documents(spark, sf):
    d = AG.cluster_documents(TD.clustered(spark, sf), ["app", "clusters"], min_size=3, max_items=PART_ITEMS)
    return d.select("app", "clusters", "part", "n", F.md5("document").alias("document_md5"),
                    F.length("document").cast("bigint").alias("document_chars"))


@register("pending_reviews", TD.with_views(TD.ANSWERS_SQL, """
SELECT review_id FROM reviews WHERE review_id NOT IN (
  SELECT review_id FROM answers WHERE result IS NOT NULL AND review_id % 2 = 0)"""))
def q_pending_reviews(spark, sf):
    ans = TD.answers(spark, sf)
    # Stored answers of the 'stub' model: those that exist and have even ids.
    resp = ans.where(F.col("result").isNotNull() & (F.col("review_id") % 2 == 0)).select(
        "review_id", F.lit("stub").alias("model"))
    return J.pending(TD.reviews(spark, sf), resp, "stub").select("review_id")


@register("attach_weights", TD.with_views(TD.CLUSTERED_SQL, """
SELECT c.review_id, c.clusters, round(w.importance, 6) AS importance
FROM clustered c LEFT JOIN (
  SELECT app, clusters, (count(*) + CAST(0.1 AS DOUBLE) * coalesce(sum(thumbsUpCount), 0)) / nullif(avg(score), 0) AS importance
  FROM clustered WHERE clusters >= 0 GROUP BY app, clusters) w ON c.app = w.app AND c.clusters = w.clusters"""))
def q_attach_weights(spark, sf):
    c = TD.clustered(spark, sf)
    w = AG.cluster_importance(c, keys=("app",)).select("app", "clusters", "importance")
    return J.attach_weights(c, w, ("app", "clusters")).select(
        "review_id", "clusters", r6("importance").alias("importance"))


# --------------------------------------------------------------------------
# Splits (E5, K10, K11)

_SPLIT_SQL = """
SELECT review_id, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_valid THEN 'valid' ELSE 'train' END AS split
FROM (
  SELECT *, CASE WHEN n <= 1 THEN 0 ELSE floor(CAST({vr} AS DOUBLE) * (n - n_test) + 0.5) END AS n_valid
  FROM (
    SELECT *, CASE WHEN n <= 1 THEN 0 ELSE floor(CAST({test} AS DOUBLE) * n + 0.5) END AS n_test
    FROM (
      SELECT review_id, count(*) OVER (PARTITION BY dataset, irrelevant, feature_request, problem_report) AS n,
        row_number() OVER (PARTITION BY dataset, irrelevant, feature_request, problem_report
                           ORDER BY md5(CAST(review_id AS VARCHAR) || '-{seed}'), review_id) AS rn
      FROM (SELECT *, app || '.' || ori_lang AS dataset FROM {src}) s) a) b) c"""


@register("stratified_split", TD.with_views(TD.LABELLED_SQL, _SPLIT_SQL.format(
    test="0.2", vr=str(0.2 / 0.8), seed="7", src="labelled")))
def q_stratified_split(spark, sf):
    l = TD.labelled(spark, sf).withColumn("dataset", F.concat_ws(".", "app", "ori_lang"))
    return SP.stratified_split(l, LABELS, 0.2, 0.2, seed=7).select("review_id", "split")


@register("leave_one_app_out", TD.with_views(
    TD.LABELLED_SQL + ",\ninner_split AS (" + _SPLIT_SQL.format(
        test="0.2", vr="0.0", seed="3", src="(SELECT * FROM labelled WHERE app <> 'src0')") + ")", """
SELECT review_id, split, 'in_domain' AS eval_set FROM inner_split
UNION ALL SELECT review_id, 'test', 'cross_app' FROM labelled WHERE app = 'src0'"""))
def q_leave_one_app_out(spark, sf):
    l = TD.labelled(spark, sf).withColumn("dataset", F.concat_ws(".", "app", "ori_lang"))
    return SP.leave_one_app_out(l, LABELS, "src0", 0.2, 0.0, seed=3).select("review_id", "split", "eval_set")


FLAGSHIP = "review_report"

# Importing the other catalogue modules registers their queries.
from critica.plans import catalog_text  # noqa: E402,F401
from critica.plans import catalog_eval  # noqa: E402,F401
from critica.plans import catalog_cluster  # noqa: E402,F401
from critica.plans import catalog_pipeline  # noqa: E402,F401
from critica.plans import catalog_classify  # noqa: E402,F401
from critica.plans import catalog_extra  # noqa: E402,F401
from critica.plans import catalog_more  # noqa: E402,F401
