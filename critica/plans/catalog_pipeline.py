"""Registered pipeline queries: the flat review report (L4) and its SQL-checkable core."""

from __future__ import annotations

from pyspark.sql import functions as F

from critica.plans.sql_twins import detect_language_sql
from critica.operators import aggregates as AG
from critica.operators import ranking as R
from critica.operators import summarize as SU
from critica.plans import analyze as A
from critica.plans.registry import r6, register
from critica.plans.catalog_text import _SENT_SQL
from critica.sources import testdata as TD


def _pipeline_input(spark, sf):
    """Reviews with a model answer and a vector; the language plays the app."""
    ans = TD.answers(spark, sf)
    emb = TD.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("review_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return ans.join(emb, "review_id")


@register("review_report", None)
def q_review_report(spark, sf):
    """Route → leaf HDBSCAN per (app, category) → importance → summary → ranked clusters."""
    counts, clusters, reviews = A.analyze(_pipeline_input(spark, sf), app_col="ori_lang")
    return clusters.select("app", "category", "cluster_rank", "clusters", "summary",
                           r6("importance").alias("importance"), "count")


@register("review_ranking", None)
def q_review_ranking(spark, sf):
    """Reviews of every reported cluster ranked by similarity to its summary."""
    counts, clusters, reviews = A.analyze(_pipeline_input(spark, sf), app_col="ori_lang")
    return reviews.select("app", "category", "clusters", "review_rank", "review_id", r6("similarity").alias("similarity"))


@register("report_flat", TD.with_views(_SENT_SQL + f""",
imp AS (SELECT ori_lang, clusters, count(*) AS n,
          (count(*) + CAST(0.1 AS DOUBLE) * coalesce(sum(thumbsUpCount), 0)) / nullif(avg(score), 0) AS importance
        FROM clustered WHERE clusters >= 0 GROUP BY ori_lang, clusters),
best AS (SELECT ori_lang, clusters, sentence FROM (
          SELECT *, row_number() OVER (PARTITION BY ori_lang, clusters ORDER BY
             CASE WHEN {detect_language_sql('sentence', ['en', 'fr'])} = 'en' THEN 1 ELSE 0 END DESC,
             round(centrality, 9) DESC, review_id, sent_id) AS rk FROM sc) t WHERE rk = 1)""", """
SELECT i.ori_lang AS app, i.clusters,
  CAST(row_number() OVER (PARTITION BY i.ori_lang ORDER BY i.importance DESC NULLS LAST, i.clusters) AS INTEGER) AS cluster_rank,
  round(i.importance, 6) AS importance, CAST(i.n AS BIGINT) AS count, md5(b.sentence) AS summary_md5
FROM imp i LEFT JOIN best b ON i.ori_lang = b.ori_lang AND i.clusters = b.clusters"""))
def q_report_flat(spark, sf):
    """Given clusters: importance, extractive summary and rank per cluster (flat report, SQL-checked)."""
    c = TD.clustered(spark, sf).drop("app").withColumnRenamed("ori_lang", "app")
    imp = AG.cluster_importance(c, ["app"], "clusters")
    ranked = R.rank_clusters(imp, ["app"], "clusters")
    summ = SU.extractive_summary(c, ["app", "clusters"])
    return (ranked.join(summ, ["app", "clusters"], "left")
            .select("app", "clusters", "cluster_rank", r6("importance").alias("importance"),
                    F.col("n").alias("count"), F.md5("summary").alias("summary_md5")))


@register("review_summary_ranking", TD.with_views(_SENT_SQL + f""",
best AS (SELECT ori_lang, clusters, sentence AS summary FROM (
          SELECT *, row_number() OVER (PARTITION BY ori_lang, clusters ORDER BY
             CASE WHEN {detect_language_sql('sentence', ['en', 'fr'])} = 'en' THEN 1 ELSE 0 END DESC,
             round(centrality, 9) DESC, review_id, sent_id) AS rk FROM sc) t WHERE rk = 1),
rt AS (SELECT ori_lang, clusters, review_id, term, CAST(count(*) AS DOUBLE) AS tf FROM
         (SELECT ori_lang, clusters, review_id,
                 unnest(regexp_extract_all(lower(data), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM clustered) x
       GROUP BY ori_lang, clusters, review_id, term),
ru AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY ori_lang, clusters, review_id)) AS u FROM rt),
bt AS (SELECT ori_lang, clusters, term, CAST(count(*) AS DOUBLE) AS tf FROM
         (SELECT ori_lang, clusters, unnest(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
          FROM best) y GROUP BY ori_lang, clusters, term),
bu AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY ori_lang, clusters)) AS su FROM bt),
sims AS (SELECT c.ori_lang, c.clusters, c.review_id, coalesce(d.sim, 0.0) AS similarity
         FROM clustered c JOIN best b ON c.ori_lang = b.ori_lang AND c.clusters = b.clusters
         LEFT JOIN (SELECT ru.ori_lang, ru.clusters, ru.review_id, sum(ru.u * bu.su) AS sim FROM ru
                    JOIN bu ON ru.ori_lang = bu.ori_lang AND ru.clusters = bu.clusters AND ru.term = bu.term
                    GROUP BY ru.ori_lang, ru.clusters, ru.review_id) d
           ON c.ori_lang = d.ori_lang AND c.clusters = d.clusters AND c.review_id = d.review_id)""", """
SELECT ori_lang AS app, clusters, review_id, round(similarity, 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY ori_lang, clusters ORDER BY round(similarity, 9) DESC, review_id) AS BIGINT)
    AS review_rank
FROM sims"""))
def q_review_summary_ranking(spark, sf):
    """Given clusters: each review's term-vector cosine to its cluster's extractive summary, ranked."""
    c = TD.clustered(spark, sf).drop("app").withColumnRenamed("ori_lang", "app")
    keys = ["app", "clusters"]
    summ = SU.extractive_summary(c, keys).select(*keys, "summary")
    members = c.join(summ.select(*keys), keys, "left_semi").select(*keys, "review_id", "data")
    sims = A.text_similarity(members, summ, keys).withColumn("similarity", F.round("similarity", 9))
    ranked = R.rank_reviews(sims, keys)
    return ranked.select("app", "clusters", "review_id", r6("similarity").alias("similarity"), "review_rank")
