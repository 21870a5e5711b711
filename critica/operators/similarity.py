"""Similarity operators without pair enumeration (§2.C4, C5, C6).

* Sentence centrality Σⱼ cos(i, j) is ûᵢ · Σⱼ ûⱼ: one sum vector per
  group, joined back — linear in the data.
* Review-to-centre similarity is an equi-join on the group key.
* The ε-neighbour join and the exact k-NN join work block against block
  (``operators.blocks``): cells around pivots cut what cannot match, and
  the rest meets in units of two bounded blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.functions import text as TX
from critica.functions import vectors as V
from critica.operators import blocks as B
from critica.operators.joins import heavy_join
from critica.session import cut_lineage, pieces

#: Bytes of written sentences, and of their vectors, that make a task.
SENTENCE_BYTES, VECTOR_BYTES = 1 << 20, 4 << 20


def sentences(df: DataFrame, keys, id_col: str = "review_id", text_col: str = "data",
              min_words: int = 5) -> DataFrame:
    """(keys, id, sent_id, sentence) for sentences of at least ``min_words`` words."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    s = df.select(*keys, id_col, F.posexplode(TX.split_sentences(text_col)).alias("sent_id", "sentence"))
    return s.where(TX.word_count("sentence") >= min_words)


def sentence_vectors(sents: DataFrame, keys, id_cols=("review_id", "sent_id"), text_col: str = "sentence") -> DataFrame:
    """Unit-length term-count vectors in long form: (keys, ids, term, u)."""
    keys = list(keys)
    ids = list(id_cols)
    tf = (sents.select(*keys, *ids, F.explode(TX.tokenize(text_col)).alias("term"))
          .groupBy(*keys, *ids, "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    norms = tf.groupBy(*keys, *ids).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return tf.join(norms, keys + ids).select(*keys, *ids, "term", (F.col("tf") / F.col("norm")).alias("u"))


def sentence_centrality(sents: DataFrame, keys, id_cols=("review_id", "sent_id"),
                        text_col: str = "sentence") -> DataFrame:
    """Σⱼ cos(i, j) over the sentences j of the same group, self included (C4).

    Sentences without a token have a zero vector and centrality 0.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ids = list(id_cols)
    # The sentence table and its vectors feed several branches; both are
    # written once so that splitting and tokenising run once.
    sents = cut_lineage(sents)
    # Tasks by the size of the data: a sentence's terms are counted, and its norm taken, where the sentence is.
    n = pieces(sents, SENTENCE_BYTES)
    u = cut_lineage(sentence_vectors(sents.repartition(n, *keys, *ids), keys, ids, text_col))
    total = cut_lineage(u.groupBy(*keys, "term").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("_n")))
    # A term that most sentences of a group have would be one task's work.
    n = pieces(u, VECTOR_BYTES)
    met = heavy_join(u, total, keys + ["term"], "_n", u.count(), parts=n).select(
        *keys, *ids, (F.col("u") * F.col("s")).alias("us"))
    cent = met.repartition(n, *keys, *ids).groupBy(*keys, *ids).agg(F.sum("us").alias("centrality"))
    return (sents.join(cent, keys + ids, "left")
            .withColumn("centrality", F.coalesce(F.col("centrality"), F.lit(0.0))))


def centroids(df: DataFrame, keys, vec_col: str = "embedding") -> DataFrame:
    """Element-wise mean vector per group (dimension-sized arrays only)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    el = df.select(*keys, F.posexplode(vec_col).alias("pos", "x"))
    m = el.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return m.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))


def similarity_to_reference(df: DataFrame, refs: DataFrame, keys, vec_col: str = "embedding",
                            ref_col: str = "centroid") -> DataFrame:
    """Cosine of every row's vector with its group's reference vector."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(refs, keys).withColumn("similarity", V.cosine(vec_col, ref_col)).drop(ref_col)


# --------------------------------------------------------------------------
# ε-neighbour join

def _points(points: DataFrame, keys, id_col: str, vec_col: str, *more):
    """(group keys, id, v, more columns), and the keys (a constant one where there is none)."""
    pts = points.select(*keys, F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)
    # One group: a key that the planner does not fold away, as it would turn its equi-joins into nested loops.
    return (pts, keys) if keys else (pts.withColumn("_g", F.pmod(F.hash("id"), F.lit(1))), ["_g"])


def epsilon_pairs(points: DataFrame, eps: float, keys=(), id_col: str = "review_id",
                  vec_col: str = "embedding", differ_col: str | None = None) -> DataFrame:
    """All pairs (lo, hi, dist) with euclidean distance ≤ eps inside each group.

    Exact, block against block (see ``operators.blocks``): cells around
    pivots cut the pairs that cannot be within eps; the others meet in units
    of two bounded blocks, which give only the pairs within eps.
    ``differ_col``: keep only pairs whose values in this column differ (e.g.
    the current component).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    pts, gkeys = _points(points, keys, id_col, vec_col, *([F.col(differ_col).alias("dc")] if differ_col else []))
    schema = T.StructType(B.key_fields(pts, gkeys) + [
        T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("dist", T.DoubleType())])
    found = B.run_units(B.block_units(pts, gkeys, eps), gkeys, B.pair_pieces(eps, differ_col is not None), schema)
    return found.select(*keys, "lo", "hi", "dist")


def neighbour_counts(points: DataFrame, pairs: DataFrame, keys=(), id_col: str = "review_id") -> DataFrame:
    """Number of points within ε of each point, itself included (min_samples counts self)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ends = pairs.select(*keys, F.col("lo").alias("id")).unionByName(pairs.select(*keys, F.col("hi").alias("id")))
    cnt = ends.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("nbrs"))
    return (points.select(*keys, F.col(id_col).alias("id")).join(cnt, keys + ["id"], "left")
            .select(*keys, F.col("id").alias(id_col), (F.coalesce(F.col("nbrs"), F.lit(0)) + 1).alias("n_eps")))



def knn_pairs(points: DataFrame, k: int, keys=(), id_col: str = "review_id", vec_col: str = "embedding") -> DataFrame:
    """Exact k nearest neighbours of every point inside its group (C6 ``knn_join``).

    Every unit of two bounded blocks gives each of its points' k nearest
    there; the k nearest of all units are kept.
    Output: keys, id, nbr, dist, rank (1..k; ties by neighbour id).
    """
    from critica.operators.ranking import top_k
    keys = [keys] if isinstance(keys, str) else list(keys)
    pts, gkeys = _points(points, keys, id_col, vec_col)
    schema = T.StructType(B.key_fields(pts, gkeys) + [
        T.StructField("id", T.LongType()), T.StructField("nbr", T.LongType()), T.StructField("dist", T.DoubleType())])
    found = B.run_units(B.block_units(pts, gkeys), gkeys, B.nearest(k), schema)
    out = top_k(found, [*gkeys, "id"], ["dist", "nbr"], k, "rank")
    return out.select(*keys, F.col("id").alias(id_col), "nbr", "dist", F.col("rank").cast("int").alias("rank"))
