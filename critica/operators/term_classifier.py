"""Multinomial naive Bayes as a table (K1, K2).

The model is rows (label, term, delta): how much a unit of a term's weight
speaks for the label rather than against it, with Laplace smoothing 1.
Fitting is one sum per (label, class, term), scoring a join on ``term`` and
a sum per (review, label).  No vocabulary is held on the driver or in a
task, and there is no bound on its size.

A review's weights are its smoothed tf-idf over the training vocabulary
(``min_df``, ``max_df``), of unit length.  Reviews without a known term are
judged by the prior alone.  A label with one class in the training rows
gets that class everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.operators.features import term_counts
from critica.schema import LABELS
from critica.session import cut_lineage


@dataclass(frozen=True)
class TermModel:
    """``vocabulary``: term, df, n_docs.  ``terms``: label, term, delta.  ``priors``: label, prior, only."""

    vocabulary: DataFrame
    terms: DataFrame
    priors: DataFrame
    stop_words: tuple[str, ...] | None


def unit_weights(tf: DataFrame, vocabulary: DataFrame, id_col: str = "review_id") -> DataFrame:
    """(id, term, w): smoothed tf-idf over a vocabulary, of unit length per review."""
    w = tf.join(vocabulary, "term").select(id_col, "term", (
        F.col("tf") * (F.ln((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0)).alias("w"))
    norms = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return w.join(norms, id_col).select(id_col, "term", (F.col("w") / F.col("_norm")).alias("w"))


def fit(train: DataFrame, labels=LABELS, id_col: str = "review_id", text_col: str = "data", stop_words=None,
        min_df: int = 3, max_df: float = 0.5) -> TermModel:
    """The model of the training rows; ``labels`` are 0/1 columns."""
    tf = term_counts(train, (), id_col, text_col, stop_words, materialize=True)
    n = train.count()
    vocabulary = cut_lineage(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(
        (F.col("df") >= min_df) & (F.col("df") <= float(max_df) * n)).withColumn("n_docs", F.lit(n).cast("long")))
    size = vocabulary.count()
    marks = F.array(*[F.struct(F.lit(label).alias("label"), F.col(label).cast("int").alias("y")) for label in labels])
    marked = train.select(id_col, F.explode(marks).alias("_m")).select(id_col, "_m.label", "_m.y")
    counts = marked.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    share = F.col("n1") / F.col("n")
    priors = counts.select("label", F.when((F.col("n1") > 0) & (F.col("n1") < F.col("n")), F.ln(share) - F.ln(1.0 - share)).alias("prior"),
                           F.when(F.col("n1") == 0, 0).when(F.col("n1") == F.col("n"), 1).alias("only"))
    by_class = unit_weights(tf, vocabulary, id_col).join(marked, id_col).groupBy("label", "term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("w1"),
        F.sum(F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))).alias("w0"))
    by_class = cut_lineage(by_class)
    totals = by_class.groupBy("label").agg(F.sum("w1").alias("t1"), F.sum("w0").alias("t0"))
    # One row a label: the broadcast holds as many rows as there are labels.
    terms = by_class.join(F.broadcast(totals), "label").select("label", "term", (
        F.ln((F.col("w1") + 1.0) / (F.col("t1") + size)) - F.ln((F.col("w0") + 1.0) / (F.col("t0") + size))).alias("delta"))
    return TermModel(vocabulary, cut_lineage(terms), cut_lineage(priors), tuple(stop_words) if stop_words else None)


def margins(model: TermModel, df: DataFrame, id_col: str = "review_id", text_col: str = "data") -> DataFrame:
    """(id, label, margin): log odds of every label; null where training rows had one class only."""
    tf = term_counts(df, (), id_col, text_col, model.stop_words, materialize=True)
    scored = unit_weights(tf, model.vocabulary, id_col).join(model.terms, "term").groupBy(id_col, "label").agg(
        F.sum(F.col("w") * F.col("delta")).alias("_s"))
    labels = model.priors.select("label", "prior")
    every = df.select(id_col, F.explode(F.array(*[F.lit(r.label) for r in labels.select("label").collect()])).alias("label"))
    return every.join(scored, [id_col, "label"], "left").join(F.broadcast(labels), "label").select(
        id_col, "label", (F.col("prior") + F.coalesce("_s", F.lit(0.0))).alias("margin"))


def predict(model: TermModel, df: DataFrame, id_col: str = "review_id", text_col: str = "data") -> DataFrame:
    """(id, pred_<label> ...): a label is given if its margin is above 0."""
    labels = [r.label for r in model.priors.select("label").orderBy("label").collect()]
    m = margins(model, df, id_col, text_col).join(F.broadcast(model.priors.select("label", "only")), "label")
    given = F.coalesce(F.col("only"), (F.col("margin") > 0).cast("int"))
    return m.groupBy(id_col).agg(*[F.max(F.when(F.col("label") == label, given)).alias(f"pred_{label}") for label in labels])
