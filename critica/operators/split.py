"""Stratified, deterministic train/valid/test splits.

Order inside a stratum is ``md5(review_id-seed)``, the same text in every
engine, so a split is reproducible and checkable by SQL.  Each stratum gets
exact sizes: ``round_half_up(test * n)`` test rows, then
``round_half_up(valid / (1 - test) * rest)`` validation rows; a one-row
stratum goes to train; ``test == 1`` sends everything to test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.operators.ranking import distributed_rank


def _half_up(x):
    return F.floor(x + F.lit(0.5))


def _parts(rows: DataFrame, strata, id_col: str, seed_col, test: float, valid: float) -> DataFrame:
    """(strata, id, split) of ``rows``, which hold the strata and the id only."""
    key = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), seed_col))
    sized = rows.join(rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")), strata)
    ranked = distributed_rank(sized.withColumn("_key", key), strata, ["_key", id_col], "_rn")
    n, rn = F.col("_n"), F.col("_rn")
    if test >= 1:
        n_test = n
    else:
        n_test = F.when(n <= 1, F.lit(0)).otherwise(_half_up(F.lit(float(test)) * n))
    if valid > 0 and test < 1:
        n_valid = _half_up(F.lit(float(valid) / (1.0 - float(test))) * (n - n_test))
        n_valid = F.when(n <= 1, F.lit(0)).otherwise(n_valid)
    else:
        n_valid = F.lit(0)
    split = (F.when(rn <= n_test, F.lit("test")).when(rn <= n_test + n_valid, F.lit("valid")).otherwise(F.lit("train")))
    return ranked.select(*strata, id_col, split.alias("split"))


def stratified_split(df: DataFrame, labels, test: float, valid: float = 0.0, seed: int = 0,
                     dataset_col: str = "dataset", id_col: str = "review_id", fit_all: bool = False) -> DataFrame:
    """Adds ``split`` ∈ {train, valid, test}; strata = (dataset, label combination).

    Ids and strata are ranked without the other columns, which join the
    result.  ``id_col`` is unique.
    ``fit_all``: every row is a training row (train, valid and test united,
    G2, Q18); no metrics should be claimed from such a fit.
    """
    if fit_all:
        return df.withColumn("split", F.lit("train"))
    strata = [dataset_col, *labels]
    parts = _parts(df.select(*strata, id_col), strata, id_col, F.lit(str(seed)), test, valid)
    return df.join(parts.select(id_col, "split"), id_col).select(*df.columns, "split")


def leave_one_app_out(df: DataFrame, labels, held_out: str, test: float, valid: float = 0.0,
                      seed: int = 0, dataset_col: str = "dataset") -> DataFrame:
    """Split the other apps in-domain; every row of ``held_out`` is a cross-app test row."""
    inside = df.where(F.col("app") != held_out)
    outside = df.where(F.col("app") == held_out)
    a = stratified_split(inside, labels, test, valid, seed, dataset_col).withColumn("eval_set", F.lit("in_domain"))
    b = outside.withColumn("split", F.lit("test")).withColumn("eval_set", F.lit("cross_app"))
    return a.unionByName(b)


def repeat_runs(df: DataFrame, labels, test: float, valid: float, seeds, dataset_col: str = "dataset") -> DataFrame:
    """All splits of all runs in one job, keyed by ``run``.

    The run list is a small driver-side configuration; the rows are
    replicated once per run by a generator (no join), then split per
    (run, stratum).
    """
    runs = F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("run_seed")
    strata = ["run_seed", dataset_col, *labels]
    rows = df.select(dataset_col, *labels, "review_id", runs)
    parts = _parts(rows, strata, "review_id", F.col("run_seed").cast("string"), test, valid)
    return df.join(parts.select("run_seed", "review_id", "split"), "review_id").select(*df.columns, "run_seed", "split")
