"""Evaluation as queries (§2.D7-D12, D16, D17).

Every metric is computed from grouped counts: the review table is scanned
once, reduced to a contingency / confusion table (small), and the metric is
formed from that table.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critica.schema import LABELS


def _keys(keys):
    return [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))


def _contingency(df: DataFrame, keys, truth: str, pred: str):
    c = df.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).cast("double").alias("nij"))
    a = c.groupBy(*keys, truth).agg(F.sum("nij").alias("ai"))
    b = c.groupBy(*keys, pred).agg(F.sum("nij").alias("bj"))
    return c, a, b


def nmi(df: DataFrame, truth: str = "ground_truth", pred: str = "clusters", keys=None) -> DataFrame:
    """Normalised mutual information, arithmetic mean of the entropies, natural log.

    Both labelings single-class → 1.0; MI ≤ 0 → 0.0.  Noise (-1) is an
    ordinary cluster (Q12).
    """
    keys = _keys(keys)
    if not keys:  # one population: a constant group key, dropped at the end
        return nmi(df.withColumn("_g", F.lit(0)), truth, pred, ["_g"]).drop("_g")
    c, a, b = _contingency(df, keys, truth, pred)
    n = a.groupBy(*keys).agg(F.sum("ai").alias("N"), F.count(F.lit(1)).alias("n_truth"))
    nb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    mi_terms = (c.join(a, keys + [truth]).join(b, keys + [pred]).join(n.select(*keys, "N"), keys)
                .select(*keys, (F.col("nij") / F.col("N") *
                                F.ln(F.col("N") * F.col("nij") / (F.col("ai") * F.col("bj")))).alias("t")))
    mi = mi_terms.groupBy(*keys).agg(F.sum("t").alias("mi"))
    ht = a.join(n.select(*keys, "N"), keys).groupBy(*keys).agg(
        (-F.sum(F.col("ai") / F.col("N") * F.ln(F.col("ai") / F.col("N")))).alias("h_truth"))
    hp = b.join(n.select(*keys, "N"), keys).groupBy(*keys).agg(
        (-F.sum(F.col("bj") / F.col("N") * F.ln(F.col("bj") / F.col("N")))).alias("h_pred"))
    j = mi.join(ht, keys).join(hp, keys).join(n, keys).join(nb, keys)
    norm = (F.col("h_truth") + F.col("h_pred")) / 2.0
    val = (F.when((F.col("n_truth") == 1) & (F.col("n_pred") == 1), F.lit(1.0))
           .when(F.col("mi") <= 0, F.lit(0.0))
           .otherwise(F.col("mi") / norm))
    return j.select(*keys, F.greatest(F.col("mi"), F.lit(0.0)).alias("mi"), "h_truth", "h_pred",
                    val.alias("nmi"))


def adjusted_rand(df: DataFrame, truth: str = "ground_truth", pred: str = "clusters", keys=None) -> DataFrame:
    """Adjusted Rand index from pair counts in double precision."""
    keys = _keys(keys)
    if not keys:  # one population: a constant group key, dropped at the end
        return adjusted_rand(df.withColumn("_g", F.lit(0)), truth, pred, ["_g"]).drop("_g")
    c, a, b = _contingency(df, keys, truth, pred)
    s = c.groupBy(*keys).agg(F.sum(F.col("nij") * F.col("nij")).alias("sq"), F.sum("nij").alias("N"))
    sa = a.groupBy(*keys).agg(F.sum(F.col("ai") * F.col("ai")).alias("sa"))
    sb = b.groupBy(*keys).agg(F.sum(F.col("bj") * F.col("bj")).alias("sb"))
    j = s.join(sa, keys).join(sb, keys)
    tp = F.col("sq") - F.col("N")
    fp = F.col("sb") - F.col("sq")
    fn = F.col("sa") - F.col("sq")
    tn = F.col("N") * F.col("N") - fp - fn - F.col("sq")
    den = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        F.try_divide(F.lit(2.0) * (tp * tn - fn * fp), den))
    return j.select(*keys, ari.alias("ari"))


def summarise_nmi(scores: DataFrame, expected_apps: int | None = 3, scale: int = 10) -> DataFrame:
    """Sum NMI per run and category prefix, divide by the app count.

    ``scores``: run, app, category ('pro'/'fea'), nmi.  The run name is
    ``<algo>-<method>-<eps>``; the grid index is ``round(eps * scale)``.
    ``expected_apps=None`` divides by the apps actually present.
    """
    from critica.functions.text import parse_run_name
    method, eps = parse_run_name(F.col("run"))
    g = scores.groupBy("run").agg(
        F.sum(F.when(F.col("category") == "pro", F.col("nmi")).otherwise(0.0)).alias("pro_sum"),
        F.sum(F.when(F.col("category") == "fea", F.col("nmi")).otherwise(0.0)).alias("fea_sum"),
        F.count_distinct("app").alias("n_apps"))
    d = F.lit(float(expected_apps)) if expected_apps else F.col("n_apps").cast("double")
    return g.select(
        "run", method.alias("method"), eps.alias("eps"),
        F.round(eps * scale).cast("int").alias("eps_index"),
        F.col("n_apps"),
        (F.col("pro_sum") / d).alias("pro"), (F.col("fea_sum") / d).alias("fea"),
        ((F.col("pro_sum") + F.col("fea_sum")) / (d * 2)).alias("avg"))


def classification_report(df: DataFrame, labels=LABELS, keys=("ori_lang",), pred_prefix: str = "pred_") -> DataFrame:
    """Per-label precision/recall/F1/support plus micro, macro, weighted and
    samples averages; 0 where undefined (D10, K9).  One aggregation pass."""
    keys = _keys(keys)
    y = {l: F.col(l).cast("double") for l in labels}
    p = {l: F.col(pred_prefix + l).cast("double") for l in labels}
    inter = sum((y[l] * p[l] for l in labels), F.lit(0.0))
    ny = sum((y[l] for l in labels), F.lit(0.0))
    npred = sum((p[l] for l in labels), F.lit(0.0))
    aggs = []
    for l in labels:
        aggs += [F.sum(y[l] * p[l]).alias(f"tp_{l}"), F.sum(p[l]).alias(f"pp_{l}"), F.sum(y[l]).alias(f"sup_{l}")]
    aggs += [
        F.avg(F.when(npred > 0, inter / npred).otherwise(0.0)).alias("s_p"),
        F.avg(F.when(ny > 0, inter / ny).otherwise(0.0)).alias("s_r"),
        F.avg(F.when(ny + npred > 0, 2.0 * inter / (ny + npred)).otherwise(0.0)).alias("s_f"),
    ]
    g = df.groupBy(*keys).agg(*aggs)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    per = {}
    for l in labels:
        tp, pp, sup = F.col(f"tp_{l}"), F.col(f"pp_{l}"), F.col(f"sup_{l}")
        per[l] = (ratio(tp, pp), ratio(tp, sup), ratio(2.0 * tp, pp + sup), sup)
    TP = sum((F.col(f"tp_{l}") for l in labels), F.lit(0.0))
    PP = sum((F.col(f"pp_{l}") for l in labels), F.lit(0.0))
    S = sum((F.col(f"sup_{l}") for l in labels), F.lit(0.0))
    k = float(len(labels))
    rows = [F.struct(F.lit(l).alias("row_name"), v[0].alias("precision"), v[1].alias("recall"),
                     v[2].alias("f1"), v[3].alias("support")) for l, v in per.items()]
    rows.append(F.struct(F.lit("micro avg").alias("row_name"), ratio(TP, PP).alias("precision"),
                         ratio(TP, S).alias("recall"), ratio(2.0 * TP, PP + S).alias("f1"), S.alias("support")))
    rows.append(F.struct(F.lit("macro avg").alias("row_name"),
                         (sum((v[0] for v in per.values()), F.lit(0.0)) / k).alias("precision"),
                         (sum((v[1] for v in per.values()), F.lit(0.0)) / k).alias("recall"),
                         (sum((v[2] for v in per.values()), F.lit(0.0)) / k).alias("f1"), S.alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("row_name"),
                         ratio(sum((v[0] * v[3] for v in per.values()), F.lit(0.0)), S).alias("precision"),
                         ratio(sum((v[1] * v[3] for v in per.values()), F.lit(0.0)), S).alias("recall"),
                         ratio(sum((v[2] * v[3] for v in per.values()), F.lit(0.0)), S).alias("f1"),
                         S.alias("support")))
    rows.append(F.struct(F.lit("samples avg").alias("row_name"), F.col("s_p").alias("precision"),
                         F.col("s_r").alias("recall"), F.col("s_f").alias("f1"), S.alias("support")))
    return g.select(*keys, F.explode(F.array(*rows)).alias("r")).select(
        *keys, "r.row_name", "r.precision", "r.recall", "r.f1", F.col("r.support").cast("bigint").alias("support"))


def average_runs(metrics: DataFrame, keys=("experiment", "row_name"), digits: int = 3) -> DataFrame:
    """Mean precision/recall/F1 over repeated runs, rounded."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[F.round(F.avg(c), digits).alias(c) for c in ("precision", "recall", "f1")])


def metrics_table(metrics: DataFrame, keys=("experiment",), rows=None, digits: int = 3) -> DataFrame:
    """One row per experiment, one column triple per class row."""
    rows = rows or ["feature_request", "problem_report", "irrelevant", "weighted avg"]
    avg = average_runs(metrics, (*keys, "row_name"), digits)
    return (avg.where(F.col("row_name").isin(rows)).groupBy(*keys).pivot("row_name", rows)
            .agg(F.first("precision").alias("p"), F.first("recall").alias("r"), F.first("f1").alias("f")))


# The four rating dimensions of a summary sheet.
DIMENSIONS = ["Relevance", "Consistency", "Fluency", "Coherence"]


def likert_means(marks: DataFrame, keys=("lang",), digits: int = 2) -> DataFrame:
    """Per language and dimension: Σ rating ÷ (dimension rows ÷ 4).

    ``marks``: lang, dimension, rating (0 when unmarked).
    """
    keys = _keys(keys)
    if not keys:
        return likert_means(marks.withColumn("_g", F.lit(0)), ["_g"], digits).drop("_g")
    per = marks.groupBy(*keys, "dimension").agg(F.sum("rating").alias("rating_sum"),
                                                F.count(F.lit(1)).alias("rows"))
    total = per.groupBy(*keys).agg(F.sum("rows").alias("all_rows"))
    return per.join(total, keys).select(
        *keys, "dimension", F.col("rating_sum").cast("bigint").alias("rating_sum"),
        F.round(F.try_divide(F.col("rating_sum").cast("double"), F.col("all_rows") / 4.0), digits).alias("mean"))


def bce_loss(df: DataFrame, labels=LABELS, prob_prefix: str = "prob_", keys=None) -> DataFrame:
    """Mean binary cross-entropy over rows × labels, log floored at -100."""
    keys = _keys(keys)
    terms = []
    for l in labels:
        y = F.col(l).cast("double")
        pr = F.col(prob_prefix + l).cast("double")
        # ln(0) is null in Spark and greatest() skips nulls: the floor applies.
        terms.append(-(y * F.greatest(F.ln(pr), F.lit(-100.0)) +
                       (1.0 - y) * F.greatest(F.ln(1.0 - pr), F.lit(-100.0))))
    per_row = sum(terms, F.lit(0.0)) / float(len(labels))
    return df.groupBy(*keys).agg(F.avg(per_row).alias("loss"), F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, labels=LABELS, prob_prefix: str = "prob_", keys=None, buckets: int = 64) -> DataFrame:
    """Exact per-label AUROC by the rank-sum (Mann-Whitney) form, ties count ½.

    Scores are first reduced to distinct values with positive/negative
    counts.  The count of negatives below each value is a prefix sum done
    in two levels: coarse score buckets (one row per bucket) and, inside a
    bucket, a window over its distinct scores, so no window spans a whole
    label.
    """
    keys = _keys(keys)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(l).alias("label"), F.col(prob_prefix + l).cast("double").alias("s"),
                 F.col(l).cast("int").alias("y")) for l in labels])).alias("r")).select(*keys, "r.*")
    h = long.groupBy(*keys, "label", "s").agg(F.sum("y").cast("double").alias("pos"),
                                              F.sum(1 - F.col("y")).cast("double").alias("neg"))
    # Bucket bounds from quantiles of the distinct scores: a handful of numbers on the driver.
    probs = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(b for b in h.approxQuantile("s", probs, 0.001) if b is not None))
    barr = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    h = h.withColumn("bucket", F.size(F.filter(barr, lambda b: b < F.col("s"))))
    gk = keys + ["label"]
    bt = h.groupBy(*gk, "bucket").agg(F.sum("neg").alias("neg_b"))
    wb = Window.partitionBy(*gk).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("neg_off", F.coalesce(F.sum("neg_b").over(wb), F.lit(0.0))).drop("neg_b")
    wi = Window.partitionBy(*gk, "bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("neg_in", F.coalesce(F.sum("neg").over(wi), F.lit(0.0))).join(bt, gk + ["bucket"])
    u = h.groupBy(*gk).agg(
        F.sum(F.col("pos") * (F.col("neg_off") + F.col("neg_in") + 0.5 * F.col("neg"))).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return u.select(*gk, F.try_divide(F.col("u"), F.col("P") * F.col("N")).alias("auroc"))
