"""Explicit joins that replace index alignment and dictionary lookups (§2.C)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def semi_join_large(df: DataFrame, key, n: int = 5) -> DataFrame:
    """Rows of groups with at least ``n`` members, as a left-semi join."""
    keys = [key] if isinstance(key, str) else list(key)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(sizes.where(F.col("_n") >= n).select(*keys), keys, "left_semi")


def attach_predictions(reviews: DataFrame, preds: DataFrame, key: str = "review_id") -> DataFrame:
    """Reviews with their predictions, aligned by key, never by position."""
    return reviews.join(preds, key, "inner")


def attach_weights(clustered: DataFrame, weights: DataFrame, keys=("app", "category", "clusters")) -> DataFrame:
    """Cluster importance looked up per review.

    ``weights`` has one row per cluster; the planner broadcasts it when its
    measured size is under the broadcast threshold and shuffles otherwise.
    """
    return clustered.join(weights, list(keys), "left")


def pending(reviews: DataFrame, responses: DataFrame, model: str, key: str = "review_id") -> DataFrame:
    """Reviews with no stored answer from ``model`` yet (C7).  A stored row with an ``error`` is no answer."""
    done = responses.where(F.col("model") == model)
    if "error" in responses.columns:
        done = done.where(F.col("error").isNull())
    done = done.select(key)
    return reviews.join(done, key, "left_anti")


#: Share of the left rows from which a key is heavy.
HEAVY = 1 / 256


def heavy_join(left: DataFrame, right: DataFrame, keys, count_col: str, n_left: int, share: float = HEAVY,
               parts: int | None = None) -> DataFrame:
    """Inner join of ``left`` with one row per key of ``right``, the heaviest keys dealt over several tasks.

    ``count_col`` of ``right`` counts the left rows of its key, ``n_left``
    all of them.  A key with more than ``share`` of the rows is cut into
    parts of at most that many, by a hash of the left row; only its right
    row is repeated.  There are at most 1 / ``share`` such keys, so the list
    that is broadcast is bounded whatever the data.  All other keys join as
    they would anyway.  The count column is not part of the result.
    ``parts``: number of partitions that the join is dealt over.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    bar = max(1, math.ceil(share * n_left))
    cuts = F.ceil(F.col(count_col) / F.lit(bar)).cast("int")
    heavy = F.broadcast(right.where(F.col(count_col) > bar).select(*keys, cuts.alias("_parts")))
    rest = [c for c in left.columns if c not in keys]
    dealt = left.join(heavy, keys, "left").withColumn("_part", F.when(
        F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rest), F.col("_parts"))).cast("int")).drop("_parts")
    repeated = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(
        F.col(count_col) > bar, cuts - 1).otherwise(F.lit(0))))).drop(count_col)
    if parts:
        dealt, repeated = (x.repartition(parts, *keys, "_part") for x in (dealt, repeated))
    return dealt.join(repeated, [*keys, "_part"]).drop("_part")
