"""Ordered and per-group positional operators (§2.E, §2.F).

Any group here may hold a third of all rows (reviews of one app, clusters
of one category), so positions inside a group come from
``distributed_rank`` (a range-partitioned sort plus per-partition offsets)
and carry-forward from ``distributed_ffill``: no task ever holds a whole
group.  Windows remain only over tables with one row per (group,
partition) and in ``top_k``, which Spark plans as a per-partition
WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critica.session import cut_lineage


def distributed_rank(df: DataFrame, keys, order, rank_col: str = "rank",
                     num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` within ``keys`` ordered by ``order``.

    ``order`` must make the order total (end it with a unique id).  The rows
    are range-partitioned on ``keys + order``, so a hot group is split over
    many partitions; each partition numbers its own run of the group, and
    a small table of (group, partition, count) supplies the offsets.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str,)) else list(order)
    # Without a given count the adaptive planner sizes the partitions from the data; their order stays.
    n = [num_partitions] if num_partitions else []
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key_cols = [F.col(k) for k in keys]
    # After the range shuffle and a sort inside each partition, the row
    # position inside the partition is deterministic and increasing; it is
    # read off monotonically_increasing_id (partition index in the high bits).
    #
    # The partition-tagged rows are read by two branches (counts and the
    # join back).  Column pruning makes the two range shuffles differ, and a
    # re-sampled range partitioner may place rows differently, so the tagged
    # rows are written once to the shared checkpoint folder and both
    # branches read that copy (this also survives executor loss).
    local = cut_lineage(df.repartitionByRange(*n, *key_cols, *order_cols)
                        .sortWithinPartitions(*key_cols, *order_cols)
                        .withColumn("_pid", F.spark_partition_id())
                        .withColumn("_pos", F.monotonically_increasing_id()))
    counts = local.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_cnt"),
                                              F.min("_pos").alias("_first"))
    # One row per (group, partition): a window over it is bounded by the
    # partition count, whatever the group size.
    w_off = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0))).drop("_cnt")
    return (local.join(offsets, keys + ["_pid"])
            .withColumn(rank_col, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_pos", "_first", "_off"))


def rank_clusters(importance: DataFrame, keys=("app", "category"), cluster_col: str = "clusters") -> DataFrame:
    """Clusters by importance, descending; ties by cluster id.

    One row per cluster; a category may still hold very many clusters, so
    the rank is a ``distributed_rank`` rather than a per-category window.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    r = distributed_rank(importance, keys, [F.desc_nulls_last("importance"), F.col(cluster_col)], "cluster_rank")
    return r.withColumn("cluster_rank", F.col("cluster_rank").cast("int"))


def top_k(df: DataFrame, keys, order, k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group (F4).  ``row_number() <= k`` plans as a
    WindowGroupLimit, which keeps only k rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def rank_reviews(scored: DataFrame, keys, sim_col: str = "similarity", id_col: str = "review_id") -> DataFrame:
    """Reviews of each cluster by similarity to its summary, descending."""
    return distributed_rank(scored, keys, [F.desc_nulls_last(sim_col), F.col(id_col)], "review_rank")


def top_sentence(sents: DataFrame, keys, score_col: str = "centrality",
                 pref_col: str = "is_english", id_cols=("review_id", "sent_id"),
                 text_col: str = "sentence") -> DataFrame:
    """The preferred sentence with the highest score per group.

    Preference first, then score, then the smallest id: one aggregate of a
    struct (partial aggregation, no group held whole).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    neg_ids = [(-F.col(c)).alias(f"neg_{c}") for c in id_cols]
    best = F.max(F.struct(F.col(pref_col).cast("int").alias("pref"), F.col(score_col).alias("score"),
                          *neg_ids, F.col(text_col).alias("text")))
    return sents.groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.text").alias("summary"), F.col("best.score").alias(score_col))


def carry_heading(lines: DataFrame, file_col: str, pos_col: str, heading_col: str, out_col: str) -> DataFrame:
    """Forward-fill the last non-null heading over the following lines.

    Lines of one file are ordered by position; files are independent.  A
    large file is split over partitions (see ``distributed_ffill``).
    """
    return distributed_ffill(lines, [file_col], [pos_col], heading_col, out_col)


def canonical_labels(df: DataFrame, keys, comp_col: str = "component", id_col: str = "review_id",
                     out_col: str = "clusters", by_component: bool = False) -> DataFrame:
    """Contiguous 0..k-1 labels per group, ordered by each component's smallest id.

    Components are first reduced to one row each, ranked (distributed, a
    group may hold very many components), and joined back; rows with a null
    component get -1 (noise).  ``by_component``: the component value already
    is the order key (e.g. DBSCAN's smallest core id, the discovery order of
    a scan by id).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    drop = []
    if not keys:
        df, keys, drop = df.withColumn("_cg", F.lit(0)), ["_cg"], ["_cg"]
    order = F.col(comp_col) if by_component else F.min(id_col)
    comps = (df.where(F.col(comp_col).isNotNull()).groupBy(*keys, comp_col)
             .agg(order.alias("_min_id")))
    ranked = distributed_rank(comps, keys, ["_min_id", comp_col], "_rk")
    ranked = ranked.select(*keys, comp_col, (F.col("_rk") - 1).cast("int").alias(out_col))
    return (df.join(ranked, keys + [comp_col], "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(-1)).cast("int")).drop(*drop))


def distributed_ffill(df: DataFrame, keys, order, value_col: str, out_col: str,
                      num_partitions: int | None = None) -> DataFrame:
    """Last non-null ``value_col`` at or before each row, per group (E6 at scale).

    Range-partitioned like ``distributed_rank``: each partition fills its
    own run of a group with a bounded window, and the value carried in from
    earlier partitions comes from a (group, partition) table.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    # Without a given count the adaptive planner sizes the partitions from the data; their order stays.
    n = [num_partitions] if num_partitions else []
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    # Written once so that every branch sees the same partition ids.
    local = cut_lineage(df.repartitionByRange(*n, *[F.col(k) for k in keys], *order_cols)
                        .withColumn("_pid", F.spark_partition_id()))
    w = (Window.partitionBy("_pid", *keys).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, 0))
    local = local.withColumn("_fill", F.last(value_col, ignorenulls=True).over(w))
    last_per = (local.where(F.col(value_col).isNotNull()).groupBy(*keys, "_pid")
                .agg(F.max_by(F.col(value_col), F.struct(*order_cols)).alias("_last")))
    # The carry into a partition is the value of the latest earlier partition
    # that has one: a window over one row per (group, partition).
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = (local.select(*keys, "_pid").distinct().join(last_per, keys + ["_pid"], "left")
             .withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last"))
    return (local.join(carry, keys + ["_pid"], "left")
            .withColumn(out_col, F.coalesce(F.col("_fill"), F.col("_carry")))
            .drop("_pid", "_fill", "_carry"))


def distributed_running_sum(df: DataFrame, keys, order, value_col: str, out_col: str,
                            num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value_col`` per group in ``order`` (exact, distributed).

    Same scheme as ``distributed_rank``: each range partition sums its own
    run of a group with a bounded window; earlier partitions contribute
    through a (group, partition) totals table.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    # Without a given count the adaptive planner sizes the partitions from the data; their order stays.
    n = [num_partitions] if num_partitions else []
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    local = cut_lineage(df.repartitionByRange(*n, *[F.col(k) for k in keys], *order_cols)
                        .withColumn("_pid", F.spark_partition_id()))
    w = (Window.partitionBy("_pid", *keys).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, 0))
    local = local.withColumn("_run", F.sum(value_col).over(w))
    totals = local.groupBy(*keys, "_pid").agg(F.sum(value_col).alias("_tot"))
    w_off = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(w_off), F.lit(0))).drop("_tot")
    return (local.join(offsets, keys + ["_pid"])
            .withColumn(out_col, F.col("_off") + F.col("_run"))
            .drop("_pid", "_run", "_off"))
