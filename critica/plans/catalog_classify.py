"""Registered classification queries (rows-only: model outputs) and the zero-shot path."""

from __future__ import annotations

from pyspark.sql import functions as F

from critica.operators import classify as K
from critica.operators import hinge as H
from critica.operators import metrics as M
from critica.operators import split as SP
from critica.operators import term_classifier as TC
from critica.operators import zero_shot as Z
from critica.plans.registry import r6, register
from critica.plans.catalog_text import STOP, STOP_SQL, TOKENS_SQL
from critica.schema import LABELS
from critica.sources import testdata as TD


def _split(spark, sf):
    l = TD.labelled(spark, sf).withColumn("dataset", F.concat_ws(".", "app", "ori_lang"))
    s = SP.stratified_split(l, LABELS, 0.2, 0.0, seed=42)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


def _report(spark, sf, algo):
    train, test = _split(spark, sf)
    fitted = K.fit_multilabel(train, algo)
    pred = K.predict_multilabel(fitted, test)
    scored = test.join(pred, "review_id")
    rep = M.classification_report(scored, LABELS, ["ori_lang"])
    return rep.select("ori_lang", "row_name", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1").alias("f1"), "support")


@register("nb_predict", None)
def q_nb_predict(spark, sf):
    """Multinomial naive Bayes per label on smoothed tf-idf; report per language (K2, K9)."""
    return _report(spark, sf, "NaiveBayes")


_HELD_OUT = "substr(md5(CAST(review_id AS VARCHAR)), 1, 1) IN ('0', '1', '2')"


def _unit_sql(name: str, rows: str) -> str:
    return f"""
{name}_toks AS (SELECT review_id, unnest({TOKENS_SQL.format(t='data')}) AS term FROM {rows}),
{name}_tf AS (SELECT review_id, term, count(*) AS tf FROM {name}_toks WHERE NOT list_contains({STOP_SQL}, term) GROUP BY ALL)"""


_NB_SQL = TD.with_views(TD.LABELLED_SQL + f""",
train AS (SELECT * FROM labelled WHERE NOT ({_HELD_OUT})),
test AS (SELECT * FROM labelled WHERE {_HELD_OUT}),""" + _unit_sql("train", "train") + "," + _unit_sql("test", "test") + """,
nd AS (SELECT count(*) AS n FROM train),
voc AS (SELECT term, count(*) AS df, any_value(n) AS n FROM train_tf, nd GROUP BY term
        HAVING count(*) >= 3 AND count(*) <= CAST(0.5 AS DOUBLE) * any_value(n)),
size AS (SELECT count(*) AS v FROM voc),
w1 AS (SELECT review_id, t.term, tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS w FROM train_tf t JOIN voc ON voc.term = t.term),
u1 AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS w FROM w1),
w2 AS (SELECT review_id, t.term, tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS w FROM test_tf t JOIN voc ON voc.term = t.term),
u2 AS (SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS w FROM w2),
marks AS (""" + " UNION ALL ".join(f"SELECT review_id, '{label}' AS label, {label} AS y FROM train" for label in LABELS) + """),
priors AS (SELECT label, ln(avg(y)) - ln(1.0 - avg(y)) AS prior FROM marks GROUP BY label),
sums AS (SELECT label, term, sum(CASE WHEN y = 1 THEN w ELSE 0.0 END) AS s1, sum(CASE WHEN y = 1 THEN 0.0 ELSE w END) AS s0
         FROM u1 JOIN marks m ON m.review_id = u1.review_id GROUP BY ALL),
tot AS (SELECT label, sum(s1) AS t1, sum(s0) AS t0 FROM sums GROUP BY label),
delta AS (SELECT s.label, term, ln((s1 + 1.0) / (t1 + v)) - ln((s0 + 1.0) / (t0 + v)) AS delta
          FROM sums s JOIN tot ON tot.label = s.label, size),
score AS (SELECT review_id, label, sum(w * delta) AS s FROM u2 JOIN delta ON delta.term = u2.term GROUP BY ALL),
every AS (SELECT review_id, label, prior FROM test, priors)""", """
SELECT e.review_id, e.label, round(prior + coalesce(s, 0.0), 6) AS margin,
       CAST(prior + coalesce(s, 0.0) > 0 AS INTEGER) AS pred
FROM every e LEFT JOIN score s ON s.review_id = e.review_id AND s.label = e.label""")


@register("nb_term_table", _NB_SQL)
def q_nb_term_table(spark, sf):
    """Naive Bayes as a table of (label, term, delta), scored by a join and a sum (K1, K2)."""
    rows = TD.labelled(spark, sf).withColumn("_held", F.substring(F.md5(F.col("review_id").cast("string")), 1, 1).isin("0", "1", "2"))
    model = TC.fit(rows.where(~F.col("_held")), LABELS, stop_words=STOP)
    m = TC.margins(model, rows.where("_held"))
    return m.select("review_id", "label", r6("margin").alias("margin"), (F.col("margin") > 0).cast("int").alias("pred"))


@register("svc_predict", None)
def q_svc_predict(spark, sf):
    """Linear SVM per label (K3, K9)."""
    return _report(spark, sf, "LinearSVC")


@register("sgd_hinge_predict", None)
def q_sgd_hinge_predict(spark, sf):
    """Linear SVM by stochastic gradient descent, on the features of the other classifiers (K3, K9)."""
    train, test = _split(spark, sf)
    features = K.fit_features(train)
    model = H.fit(features.transform(train), LABELS, "features", width=max(1, len(features.vocabulary)))
    scored = test.join(H.predict(model, features.transform(test), "features"), "review_id")
    rep = M.classification_report(scored, LABELS, ["ori_lang"])
    return rep.select("ori_lang", "row_name", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1").alias("f1"), "support")


@register("kernel_svc_predict", None)
def q_kernel_svc_predict(spark, sf):
    """Random Fourier features + linear SVM (K4 re-aimed, K9)."""
    return _report(spark, sf, "SVC")


@register("rf_predict", None)
def q_rf_predict(spark, sf):
    """Random forest, 100 trees, per label (K5, K9)."""
    return _report(spark, sf, "RandomForest")


@register("lr_head_predict", None)
def q_lr_head_predict(spark, sf):
    """Logistic head per label over frozen encoder vectors (K6 re-aimed)."""
    emb = TD.table(spark, sf, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")
    from pyspark.ml.functions import array_to_vector
    l = (TD.labelled(spark, sf).join(emb, "review_id")
         .withColumn("vec", array_to_vector(F.col("embedding").cast("array<double>")))
         .withColumn("dataset", F.concat_ws(".", "app", "ori_lang")))
    s = SP.stratified_split(l, LABELS, 0.2, 0.0, seed=42)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    fitted = K.fit_multilabel(train, "LogisticHead", features_col="vec")
    pred = K.predict_multilabel(fitted, test, threshold=0.5)
    scored = test.join(pred, "review_id")
    loss = M.bce_loss(scored, LABELS, keys=["ori_lang"])
    return loss.select("ori_lang", r6("loss").alias("loss"), "n")


@register("reduce_dimension", None)
def q_reduce_dimension(spark, sf):
    """Unit-normalised vectors projected to 20 and 2 dimensions."""
    c = TD.clustered(spark, sf)
    r = K.reduce_dimension(c, 20, "embedding", "reduced")
    r = K.reduce_dimension(r, 2, "embedding", "plot2d")
    return r.select("review_id", "clusters", F.col("plot2d")[0].alias("dim1"), F.col("plot2d")[1].alias("dim2"),
                    F.size("reduced").alias("n_dims"))


@register("zero_shot", None)
def q_zero_shot(spark, sf):
    """Prompts → pending → offline stub client → routing (K8); the client is injected."""
    ans = Z.zero_shot(TD.reviews(spark, sf), Z.StubClientFactory(), model="stub")
    return ans.select("review_id", "lang_name", "is_fea", "is_pro", "is_irr")
