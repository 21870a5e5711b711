"""Grouped aggregations (§2.D).  Each is one shuffle on its group key with
map-side partial aggregation; no per-group loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.functions import text as TX


def category_counts(routed: DataFrame, by=("app",)) -> DataFrame:
    """Total reviews and routed reviews per category, in one pass.

    ``routed`` carries ``is_fea``/``is_pro``/``is_irr`` (see ``route_by_text``).
    """
    return routed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.sum(F.col("is_fea").cast("bigint")).alias("n_feature_request"),
        F.sum(F.col("is_pro").cast("bigint")).alias("n_problem_report"),
        F.sum(F.col("is_irr").cast("bigint")).alias("n_irrelevant"),
        F.sum((~(F.col("is_fea") | F.col("is_pro") | F.col("is_irr"))).cast("bigint")).alias("n_unrouted"),
    )


def cluster_importance(df: DataFrame, keys=("app", "category"), cluster_col: str = "clusters") -> DataFrame:
    """``(n + 0.1 * sum(thumbs)) / avg(score)`` per non-noise cluster.

    A zero or missing mean rating gives null (never a division error).
    """
    return (df.where(F.col(cluster_col) >= 0)
            .groupBy(*keys, cluster_col)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("thumbsUpCount").alias("thumbs"),
                 F.avg("score").alias("avg_score"))
            .select(*keys, cluster_col, "n",
                    F.try_divide(F.col("n") + F.lit(0.1) * F.coalesce(F.col("thumbs"), F.lit(0)),
                                 F.col("avg_score")).alias("importance")))


def cluster_count(df: DataFrame, keys=("app", "category"), cluster_col: str = "clusters") -> DataFrame:
    """``max(cluster) + 1`` per group; 0 when all noise (D3)."""
    return df.groupBy(*keys).agg(
        F.greatest(F.coalesce(F.max(cluster_col), F.lit(-1)) + 1, F.lit(0)).cast("int").alias("n_clusters"))


def label_distribution(df: DataFrame, labels, by=("app", "ori_lang")) -> DataFrame:
    """Total and per-label counts."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"),
                               *[F.sum(F.col(l).cast("bigint")).alias(l) for l in labels])


def cluster_size_stats(df: DataFrame, keys=("app",), cluster_col: str = "ground_truth", n: int = 5) -> DataFrame:
    """Number of clusters and number with at least ``n`` members."""
    sizes = df.where(F.col(cluster_col).isNotNull()).groupBy(*keys, cluster_col).count()
    return sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum((F.col("count") >= n).cast("bigint")).alias("n_large"),
        F.sum(F.when(F.col("count") >= n, F.col("count")).otherwise(0)).alias("n_in_large"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()


def sorted_prefixes(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct first words of names, as one array (F5, G4).  The set is small by construction."""
    return df.agg(F.array_sort(F.collect_set(F.split(F.col(col), " ").getItem(0))).alias("prefixes"))


def cluster_documents(df: DataFrame, keys, text_col: str = "data", id_col: str = "review_id",
                      min_size: int = 5, max_items: int = 10000) -> DataFrame:
    """Reviews of each group of at least ``min_size`` joined by the separator.

    Order inside the document is by review id.  A group's document is
    emitted in ``part`` rows of at most ``max_items`` reviews each, a parameter (part 0,
    1, …; concatenated with the separator they give the whole document), so
    no row or task holds an unbounded group.
    """
    from critica.operators.ranking import distributed_rank
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = df.where(F.col(keys[-1]).isNotNull())
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    big = d.join(sizes, keys)
    # Ids are ranked without their texts, which join the result.
    ranked = distributed_rank(big.select(*keys, "n", id_col), keys, [id_col], "_item").drop(*keys)
    parts = d.select(*keys, id_col, text_col).join(ranked, id_col) \
        .withColumn("part", F.floor((F.col("_item") - 1) / max_items).cast("int"))
    g = parts.groupBy(*keys, "part").agg(
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col("_item"), F.col(text_col)))).alias("items"))
    return g.select(*keys, "part", "n",
                    TX.join_document(F.transform("items", lambda x: x[text_col])).alias("document"))
