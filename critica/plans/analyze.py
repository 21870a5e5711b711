"""The review-report pipeline.

route → cluster each (app, category) → importance → summary → rank
clusters and reviews, for every app in one job.  The primary outputs are
two flat tables that stay distributed at any size:

* clusters: app, category, cluster_rank, clusters, summary, importance, count
* reviews:  app, category, clusters, review_rank, review_id, data, similarity

``assemble_report`` nests them into one record per app (the JSON report);
that step holds a whole app in one row by definition, so it is the
presentation step for bounded outputs, not part of the scalable core.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.operators import aggregates as AG
from critica.operators import cluster as C
from critica.operators import ranking as R
from critica.operators import routing as RT
from critica.operators import summarize as SU
from critica.operators.similarity import sentence_vectors
from critica.session import cut_lineage

CATEGORY_NAMES = {"fea": "feature_request", "pro": "problem_report", "irr": "irrelevant"}


@dataclass
class Components:
    """Injected stages (N1): each maps a DataFrame to a DataFrame.

    * ``classify``: reviews → reviews + ``result`` (used when no answer column exists)
    * ``cluster``: points (keys, review_id, embedding) → (keys, review_id, clusters)
    * ``summarize``: cluster members (keys, review_id, data) → (keys, summary)
    """
    cluster: Callable = None
    summarize: Callable = None
    classify: Callable | None = None


def default_components(min_cluster_size: int = 5) -> Components:
    return Components(
        cluster=lambda pts, keys: C.hdbscan_leaf(pts, min_cluster_size, keys),
        summarize=lambda members, keys: SU.extractive_summary(members, keys).select(*keys, "summary"),
    )


def text_similarity(reviews: DataFrame, summaries: DataFrame, keys, id_col: str = "review_id",
                    text_col: str = "data") -> DataFrame:
    """Cosine between each review's and its cluster summary's term vectors.

    Long form on both sides, joined on (cluster key, term): linear in the
    data, and the same encoder as the extractive summariser.
    """
    keys = list(keys)
    rv = sentence_vectors(reviews.select(*keys, id_col, F.col(text_col).alias("sentence")), keys, [id_col])
    sv = sentence_vectors(summaries.select(*keys, F.col("summary").alias("sentence"), F.lit(0).alias("_s")),
                          keys, ["_s"]).select(*keys, "term", F.col("u").alias("su"))
    dots = rv.join(sv, keys + ["term"]).groupBy(*keys, id_col).agg(F.sum(F.col("u") * F.col("su")).alias("sim"))
    return (reviews.select(*keys, id_col).join(dots, keys + [id_col], "left")
            .withColumn("similarity", F.coalesce(F.col("sim"), F.lit(0.0))).drop("sim"))


def analyze(reviews: DataFrame, components: Components | None = None, app_col: str = "app",
            vec_col: str = "embedding"):
    """Flat report tables and per-app counts for every app at once (L4).

    ``reviews``: review_id, app, data, score, thumbsUpCount, embedding and
    either ``result`` (an existing answer) or a ``classify`` component.
    Returns (counts, clusters, reviews) DataFrames.
    """
    comp = components or default_components()
    df = reviews.drop("app").withColumnRenamed(app_col, "app") if app_col != "app" else reviews
    if "result" not in df.columns:
        if comp.classify is None:
            raise ValueError("reviews carry no 'result' and no classify component was given")
        df = comp.classify(df)
    counts = AG.category_counts(RT.route_by_text(df), ["app"])
    routed = RT.route_long(df, keep=("review_id",)).where(F.col("category").isin("fea", "pro"))
    members = df.join(routed, "review_id")
    keys = ["app", "category"]
    labels = comp.cluster(members.select(*keys, "review_id", vec_col), keys)
    # The labelled members feed importance, summaries, similarities and the
    # review table; the clustering (a grouped task) runs once and is written.
    clustered = cut_lineage(members.drop(vec_col).join(labels, keys + ["review_id"]))
    in_clusters = clustered.where(F.col("clusters") >= 0)
    ckeys = keys + ["clusters"]
    importance = AG.cluster_importance(clustered, keys, "clusters")
    summaries = cut_lineage(comp.summarize(in_clusters.select(*ckeys, "review_id", "data"), ckeys))
    ranked = R.rank_clusters(importance, keys, "clusters")
    cluster_table = (ranked.join(summaries, ckeys, "left")
                     .select(*keys, "cluster_rank", "clusters", "summary", "importance",
                             F.col("n").alias("count")))
    sims = text_similarity(in_clusters.select(*ckeys, "review_id", "data"), summaries, ckeys)
    review_table = (R.rank_reviews(sims, ckeys).join(in_clusters.select(*ckeys, "review_id", "data"),
                                                     ckeys + ["review_id"])
                    .select(*ckeys, "review_rank", "review_id", "data", "similarity"))
    return counts, cluster_table, review_table


def assemble_report(counts: DataFrame, clusters: DataFrame, reviews: DataFrame) -> DataFrame:
    """Nested report, one row per app (D14): clusters by importance, reviews by similarity."""
    ckeys = ["app", "category", "clusters"]
    rev = reviews.groupBy(*ckeys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("review_rank", "data"))), lambda x: x["data"])
        .alias("reviews"))
    cl = clusters.join(rev, ckeys, "left")
    per_cat = cl.groupBy("app", "category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(
            "cluster_rank", F.struct("summary", "importance", F.col("count").cast("bigint").alias("count"),
                                     F.coalesce("reviews", F.array().cast("array<string>")).alias("reviews"))
            .alias("c")))), lambda x: x["c"]).alias("clusters"))
    pivot = per_cat.groupBy("app").agg(
        *[F.first(F.when(F.col("category") == k, F.col("clusters")), ignorenulls=True).alias(f"{k}_clusters")
          for k in ("fea", "pro")])
    empty = F.array().cast("array<struct<summary:string,importance:double,count:bigint,reviews:array<string>>>")
    return counts.join(pivot, "app", "left").select(
        "app", F.col("n_reviews").alias("count"),
        F.struct(F.col("n_problem_report").alias("count"),
                 F.coalesce("pro_clusters", empty).alias("clusters")).alias("problem_report"),
        F.struct(F.col("n_feature_request").alias("count"),
                 F.coalesce("fea_clusters", empty).alias("clusters")).alias("feature_request"),
        F.struct(F.col("n_irrelevant").alias("count")).alias("irrelevant"))


def flatten_report(reports: DataFrame) -> DataFrame:
    """Report records → one row per (app, category, cluster, review) with positions."""
    from critica.functions.text import app_slug
    cats = reports.select("app", F.explode(F.array(
        F.struct(F.lit("problem_report").alias("category"), F.col("problem_report.clusters").alias("clusters")),
        F.struct(F.lit("feature_request").alias("category"), F.col("feature_request.clusters").alias("clusters"))
    )).alias("c")).select("app", "c.category", "c.clusters")
    cl = cats.select("app", "category", F.posexplode("clusters").alias("cluster_pos", "cl"))
    rv = cl.select("app", "category", "cluster_pos", F.col("cl.summary").alias("summary"),
                   F.col("cl.importance").alias("importance"), F.col("cl.count").alias("count"),
                   F.posexplode_outer("cl.reviews").alias("review_pos", "review"))
    return rv.withColumn("app_slug", app_slug("app"))


#: Schema of a report part as JSON.
PART = ("app string, category string, cluster_rank bigint, part bigint, "
        "cluster struct<summary:string,importance:double,count:bigint>, reviews array<string>")
#: Reviews of a report part.
PART_REVIEWS = 1000


def report_parts(clusters: DataFrame, reviews: DataFrame, size: int = PART_REVIEWS) -> DataFrame:
    """The report as records of at most ``size`` reviews: one row per (app, category, cluster, part).

    A cluster of any number of reviews is as many rows as it needs, all
    with the cluster's head; ``review_rank`` counts from 1 in its cluster.
    A cluster without reviews has one part without any.  Whole reports are
    read by ``app``; none has to fit a row.
    """
    ckeys = ["app", "category", "clusters"]
    part = F.floor((F.col("review_rank") - 1) / F.lit(size)).cast("bigint")
    parts = reviews.withColumn("part", part).groupBy(*ckeys, "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("review_rank", "data"))), lambda x: x["data"]).alias("reviews"))
    head = clusters.select(*ckeys, F.col("cluster_rank").cast("bigint").alias("cluster_rank"), F.struct(
        "summary", "importance", F.col("count").cast("bigint").alias("count")).alias("cluster"))
    return head.join(parts, ckeys, "left").select(
        "app", F.when(F.col("category") == "pro", "problem_report").when(F.col("category") == "fea", "feature_request")
        .otherwise(F.col("category")).alias("category"),
        "cluster_rank", F.coalesce("part", F.lit(0).cast("bigint")).alias("part"), "cluster",
        F.coalesce("reviews", F.array().cast("array<string>")).alias("reviews"))


def parts_to_json(parts: DataFrame) -> DataFrame:
    """(app, json): one text per part, non-ASCII kept."""
    return parts.select("app", F.to_json(F.struct(*parts.columns)).alias("json"))


def parts_from_json(texts: DataFrame) -> DataFrame:
    return texts.select(F.from_json("json", PART).alias("p")).select("p.*")


def flatten_parts(parts: DataFrame, size: int = PART_REVIEWS) -> DataFrame:
    """Report parts → one row per (app, category, cluster, review) with positions."""
    from critica.functions.text import app_slug
    rows = parts.select("app", "category", (F.col("cluster_rank") - 1).cast("int").alias("cluster_pos"), "part",
                        "cluster.summary", "cluster.importance", "cluster.count", F.posexplode_outer("reviews").alias("_pos", "review"))
    return rows.select("app", "category", "cluster_pos", "summary", "importance", "count",
                       (F.col("part") * size + F.col("_pos")).cast("int").alias("review_pos"), "review", app_slug("app").alias("app_slug"))
