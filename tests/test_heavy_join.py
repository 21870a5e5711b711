"""The join that deals heavy keys over several tasks."""
import random
from collections import Counter

from pyspark.sql import functions as F

from critica.operators.joins import heavy_join


def test_same_rows_as_a_plain_join_and_even_tasks(spark):
    rng = random.Random(3)
    keys = [0] * 12_000 + [1] * 6_000 + [rng.randrange(2, 3_000) for _ in range(18_000)]
    left = spark.createDataFrame([(k, i, float(i % 7)) for i, k in enumerate(keys)], "k int, id long, u double").repartition(8)
    right = left.groupBy("k").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("n"))
    got = heavy_join(left, right, "k", "n", len(keys))
    assert got.columns == ["k", "id", "u", "s"]
    plain = left.join(right.drop("n"), "k")
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    old = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        dealt = heavy_join(left, right, "k", "n", len(keys))
        sizes = sorted(Counter(r.p for r in dealt.select(F.spark_partition_id().alias("p")).collect()).values())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
        skewed = sorted(Counter(r.p for r in left.join(right, "k").select(F.spark_partition_id().alias("p")).collect()).values())
        assert skewed[-1] > 3 * skewed[len(skewed) // 2]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_empty_and_single_key(spark):
    left = spark.createDataFrame([], "k int, id long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert heavy_join(left, right, "k", "n", 0).count() == 0
    one = spark.range(1000).select(F.lit("x").alias("k"), "id")
    r = one.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    assert heavy_join(one, r, "k", "n", 1000).agg(F.sum("m")).first()[0] == 999_000


def test_parts_by_the_size_of_the_data(spark):
    from critica.session import cut_lineage, pieces
    small = cut_lineage(spark.range(1000).select("id", F.rand(1).alias("u")).repartition(4))
    large = cut_lineage(spark.range(200_000).select("id", F.rand(1).alias("u")).repartition(4))
    assert pieces(small, 1 << 20) == 2 and pieces(large, 1 << 17) > 4 * pieces(small, 1 << 17)
    left = spark.range(5000).select((F.col("id") % 300).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = heavy_join(left, right, "k", "n", 5000, parts=37)
    assert got.rdd.getNumPartitions() == 37
    plain = left.join(right.drop("n"), "k")
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
