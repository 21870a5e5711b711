"""Experiment drivers: clustering runs and their evaluation (J8, D9), classification runs.

Configurations are small driver-side dataclasses; every data step is a
Spark job over all apps, categories and runs at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.operators import cluster as C
from critica.operators import metrics as M
from critica.operators import routing as RT


@dataclass(frozen=True)
class ClusteringRun:
    """One run: name prefix, algorithm, its arguments, ε, language filter."""
    name: str = "hdbscan"
    method: str = "embedding"
    algorithm: str = "HDBSCAN"
    args: dict = field(default_factory=dict)
    eps: float = 0.0
    lang: str = "bi"

    @property
    def run(self) -> str:
        return f"{self.name}-{self.method}-{self.eps}"


def clustering_experiment(embedded: DataFrame, runs, vec_col: str = "reduced", path: str | None = None,
                          keys=("app", "category")) -> DataFrame:
    """Language filter → cluster each (app, category) → keep the output columns, per run.

    Output: run, app, category, review_id, data, ground_truth, clusters,
    ori_lang; written partitioned by run/app/category when ``path`` is given.
    """
    keys = list(keys)
    out = None
    for r in runs:
        df = RT.filter_language(embedded, r.lang)
        if "method" in df.columns:
            df = df.where(F.col("method") == r.method)
        pts = df.select(*keys, "review_id", F.col(vec_col).alias("embedding"))
        args = dict(r.args)
        if r.algorithm == "HDBSCAN":
            args.setdefault("cluster_selection_epsilon", r.eps)
        lab = C.cluster(pts, r.algorithm, keys, **args)
        res = df.join(lab, keys + ["review_id"]).select(
            F.lit(r.run).alias("run"), *keys, "review_id", "data", "ground_truth", "clusters", "ori_lang")
        out = res if out is None else out.unionByName(res)
    if path:
        out.write.mode("overwrite").partitionBy("run", *keys).parquet(path)
    return out


def evaluate_clustering(clustered: DataFrame, min_size: int = 5, expected_apps: int | None = 3, scale: int = 10):
    """Ground-truth groups of at least ``min_size`` → NMI per (run, app, category) → grid.

    The category prefix is the first three letters of the category name.
    """
    from critica.functions.text import category_prefix
    c = clustered.withColumn("category", category_prefix("category"))
    keys = ["run", "app", "category"]
    big = RT.keep_large_groups(c, keys + ["ground_truth"], min_size)
    scores = M.nmi(big, "ground_truth", "clusters", keys)
    return scores, M.summarise_nmi(scores, expected_apps, scale)
