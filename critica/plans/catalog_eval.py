"""Registered evaluation queries (§7.6 rows 9-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from critica.operators import likert as LK
from critica.operators import metrics as M
from critica.operators import routing as RT
from critica.plans.registry import r6, register
from critica.schema import LABELS
from critica.sources import testdata as TD

# --------------------------------------------------------------------------
# Clustering agreement

RUNS = ["hdbscan-tfidf-0.0", "hdbscan-tfidf-0.1", "hdbscan-multilingual-e5-0.0"]


def _noisy_pred(salt_col):
    """A cluster labelling derived from the truth: shifted for some rows, noise for others."""
    h = F.substring(F.md5(F.concat_ws("-", F.col("review_id").cast("string"), salt_col)), 1, 1)
    return (F.when(h == "f", F.lit(-1))
            .when(h.isin("0", "1", "2"), (F.col("clusters") + 1) % 10)
            .otherwise(F.col("clusters"))).cast("int")


def _noisy_pred_sql(salt_sql: str) -> str:
    h = f"substr(md5(CAST(review_id AS VARCHAR) || '-' || {salt_sql}), 1, 1)"
    return (f"CAST(CASE WHEN {h} = 'f' THEN -1 WHEN {h} IN ('0', '1', '2') THEN (clusters + 1) % 10 "
            f"ELSE clusters END AS INTEGER)")


_AGREE_SQL = TD.CLUSTERED_SQL + f""",
cp AS (SELECT ori_lang, clusters AS t, {_noisy_pred_sql("'x'")} AS p FROM clustered
       WHERE (ori_lang, clusters) IN (SELECT ori_lang, clusters FROM clustered GROUP BY ori_lang, clusters
                                      HAVING count(*) >= 5)),
c AS (SELECT ori_lang, t, p, CAST(count(*) AS DOUBLE) AS nij FROM cp GROUP BY ori_lang, t, p),
a AS (SELECT ori_lang, t, sum(nij) AS ai FROM c GROUP BY ori_lang, t),
b AS (SELECT ori_lang, p, sum(nij) AS bj FROM c GROUP BY ori_lang, p)"""


@register("nmi", TD.with_views(_AGREE_SQL + """,
n AS (SELECT ori_lang, sum(ai) AS nn, count(*) AS nt FROM a GROUP BY ori_lang),
nb AS (SELECT ori_lang, count(*) AS np FROM b GROUP BY ori_lang),
mi AS (SELECT c.ori_lang, sum(nij / nn * ln(nn * nij / (ai * bj))) AS mi FROM c
       JOIN a ON c.ori_lang = a.ori_lang AND c.t = a.t JOIN b ON c.ori_lang = b.ori_lang AND c.p = b.p
       JOIN n ON c.ori_lang = n.ori_lang GROUP BY c.ori_lang),
ht AS (SELECT a.ori_lang, -sum(ai / nn * ln(ai / nn)) AS h_truth FROM a JOIN n ON a.ori_lang = n.ori_lang GROUP BY a.ori_lang),
hp AS (SELECT b.ori_lang, -sum(bj / nn * ln(bj / nn)) AS h_pred FROM b JOIN n ON b.ori_lang = n.ori_lang GROUP BY b.ori_lang)""", """
SELECT mi.ori_lang, round(greatest(mi, 0), 6) AS mi, round(h_truth, 6) AS h_truth, round(h_pred, 6) AS h_pred,
  round(CASE WHEN nt = 1 AND np = 1 THEN 1.0 WHEN mi <= 0 THEN 0.0 ELSE mi / ((h_truth + h_pred) / 2) END, 6) AS nmi
FROM mi JOIN ht ON mi.ori_lang = ht.ori_lang JOIN hp ON mi.ori_lang = hp.ori_lang
JOIN n ON mi.ori_lang = n.ori_lang JOIN nb ON mi.ori_lang = nb.ori_lang"""))
def q_nmi(spark, sf):
    c = RT.keep_large_groups(TD.clustered(spark, sf), ["ori_lang", "clusters"], 5)
    c = c.withColumn("pred", _noisy_pred(F.lit("x")))
    r = M.nmi(c, "clusters", "pred", ["ori_lang"])
    return r.select("ori_lang", *[r6(x).alias(x) for x in ("mi", "h_truth", "h_pred", "nmi")])


@register("adjusted_rand", TD.with_views(_AGREE_SQL + """,
s AS (SELECT ori_lang, sum(nij * nij) AS sq, sum(nij) AS nn FROM c GROUP BY ori_lang),
sa AS (SELECT ori_lang, sum(ai * ai) AS sa FROM a GROUP BY ori_lang),
sb AS (SELECT ori_lang, sum(bj * bj) AS sb FROM b GROUP BY ori_lang),
pc AS (SELECT s.ori_lang, sq - nn AS tp, sb - sq AS fp, sa - sq AS fn, nn * nn - (sb - sq) - (sa - sq) - sq AS tn
       FROM s JOIN sa ON s.ori_lang = sa.ori_lang JOIN sb ON s.ori_lang = sb.ori_lang)""", """
SELECT ori_lang, round(CASE WHEN fn = 0 AND fp = 0 THEN 1.0
  ELSE 2.0 * (tp * tn - fn * fp) / nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 0) END, 6) AS ari FROM pc"""))
def q_adjusted_rand(spark, sf):
    c = RT.keep_large_groups(TD.clustered(spark, sf), ["ori_lang", "clusters"], 5)
    c = c.withColumn("pred", _noisy_pred(F.lit("x")))
    return M.adjusted_rand(c, "clusters", "pred", ["ori_lang"]).select("ori_lang", r6("ari").alias("ari"))


_RUNS_SQL = "[" + ", ".join(f"'{r}'" for r in RUNS) + "]"


@register("nmi_summary", TD.with_views(TD.CLUSTERED_SQL + f""",
rr AS (SELECT *, unnest({_RUNS_SQL}) AS run FROM clustered),
cp0 AS (SELECT run, ori_lang AS app, CASE WHEN review_id % 2 = 0 THEN 'pro' ELSE 'fea' END AS category,
               clusters AS t, {_noisy_pred_sql('run')} AS p FROM rr),
cp AS (SELECT * FROM cp0 WHERE (run, app, category, t) IN
        (SELECT run, app, category, t FROM cp0 GROUP BY run, app, category, t HAVING count(*) >= 5)),
c AS (SELECT run, app, category, t, p, CAST(count(*) AS DOUBLE) AS nij FROM cp GROUP BY run, app, category, t, p),
a AS (SELECT run, app, category, t, sum(nij) AS ai FROM c GROUP BY run, app, category, t),
b AS (SELECT run, app, category, p, sum(nij) AS bj FROM c GROUP BY run, app, category, p),
n AS (SELECT run, app, category, sum(ai) AS nn, count(*) AS nt FROM a GROUP BY run, app, category),
nb AS (SELECT run, app, category, count(*) AS np FROM b GROUP BY run, app, category),
mi AS (SELECT c.run, c.app, c.category, sum(nij / nn * ln(nn * nij / (ai * bj))) AS mi FROM c
       JOIN a USING (run, app, category, t) JOIN b USING (run, app, category, p) JOIN n USING (run, app, category)
       GROUP BY c.run, c.app, c.category),
ht AS (SELECT run, app, category, -sum(ai / nn * ln(ai / nn)) AS h_truth FROM a JOIN n USING (run, app, category)
       GROUP BY run, app, category),
hp AS (SELECT run, app, category, -sum(bj / nn * ln(bj / nn)) AS h_pred FROM b JOIN n USING (run, app, category)
       GROUP BY run, app, category),
scores AS (SELECT run, app, category,
             CASE WHEN nt = 1 AND np = 1 THEN 1.0 WHEN mi <= 0 THEN 0.0 ELSE mi / ((h_truth + h_pred) / 2) END AS nmi
           FROM mi JOIN ht USING (run, app, category) JOIN hp USING (run, app, category)
           JOIN n USING (run, app, category) JOIN nb USING (run, app, category)),
g AS (SELECT run, sum(CASE WHEN category = 'pro' THEN nmi ELSE 0 END) AS pro_sum,
             sum(CASE WHEN category = 'fea' THEN nmi ELSE 0 END) AS fea_sum, count(DISTINCT app) AS n_apps
      FROM scores GROUP BY run)""", """
SELECT run, array_to_string(string_split(run, '-')[2:len(string_split(run, '-')) - 1], '-') AS method,
  CAST(string_split(run, '-')[-1] AS DOUBLE) AS eps,
  CAST(round(CAST(string_split(run, '-')[-1] AS DOUBLE) * 10) AS INTEGER) AS eps_index,
  CAST(n_apps AS BIGINT) AS n_apps, round(pro_sum / n_apps, 6) AS pro, round(fea_sum / n_apps, 6) AS fea,
  round((pro_sum + fea_sum) / (n_apps * 2), 6) AS avg
FROM g"""))
def q_nmi_summary(spark, sf):
    c = TD.clustered(spark, sf).withColumn("run", F.explode(F.array(*[F.lit(r) for r in RUNS])))
    c = c.select("run", F.col("ori_lang").alias("app"),
                 F.when(F.col("review_id") % 2 == 0, F.lit("pro")).otherwise(F.lit("fea")).alias("category"),
                 "clusters", _noisy_pred(F.col("run")).alias("pred"), "review_id")
    keys = ["run", "app", "category"]
    c = RT.keep_large_groups(c, keys + ["clusters"], 5)
    scores = M.nmi(c, "clusters", "pred", keys)
    s = M.summarise_nmi(scores, expected_apps=None)
    return s.select("run", "method", "eps", F.col("eps_index").cast("int").alias("eps_index"),
                    F.col("n_apps").cast("bigint").alias("n_apps"), r6("pro").alias("pro"),
                    r6("fea").alias("fea"), r6("avg").alias("avg"))


# --------------------------------------------------------------------------
# Classification metrics

def _report_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    short = {"irrelevant": "i", "feature_request": "f", "problem_report": "p"}
    aggs = []
    for l, s in short.items():
        aggs += [f"sum(CAST({l} * pred_{l} AS DOUBLE)) AS tp_{s}", f"sum(CAST(pred_{l} AS DOUBLE)) AS pp_{s}",
                 f"sum(CAST({l} AS DOUBLE)) AS sup_{s}"]
    inter = " + ".join(f"{l} * pred_{l}" for l in short)
    ny = " + ".join(short)
    npred = " + ".join(f"pred_{l}" for l in short)
    aggs += [f"avg(CASE WHEN ({npred}) > 0 THEN CAST({inter} AS DOUBLE) / ({npred}) ELSE 0.0 END) AS s_p",
             f"avg(CASE WHEN ({ny}) > 0 THEN CAST({inter} AS DOUBLE) / ({ny}) ELSE 0.0 END) AS s_r",
             f"avg(CASE WHEN ({ny}) + ({npred}) > 0 THEN 2.0 * ({inter}) / (({ny}) + ({npred})) ELSE 0.0 END) AS s_f"]

    def ratio(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"

    per = {}
    for l, s in short.items():
        per[l] = (ratio(f"tp_{s}", f"pp_{s}"), ratio(f"tp_{s}", f"sup_{s}"),
                  ratio(f"2.0 * tp_{s}", f"pp_{s} + sup_{s}"), f"sup_{s}")
    TP = " + ".join(f"tp_{s}" for s in short.values())
    PP = " + ".join(f"pp_{s}" for s in short.values())
    S = " + ".join(f"sup_{s}" for s in short.values())
    rows = [f"SELECT {k}, '{l}' AS row_name, {v[0]} AS precision, {v[1]} AS recall, {v[2]} AS f1, {v[3]} AS support FROM g"
            for l, v in per.items()]
    rows.append(f"SELECT {k}, 'micro avg', {ratio(TP, PP)}, {ratio(TP, S)}, {ratio('2.0 * (' + TP + ')', PP + ' + ' + S)}, {S} FROM g")
    rows.append(f"SELECT {k}, 'macro avg', ({' + '.join(v[0] for v in per.values())}) / 3.0, "
                f"({' + '.join(v[1] for v in per.values())}) / 3.0, ({' + '.join(v[2] for v in per.values())}) / 3.0, {S} FROM g")
    rows.append(f"SELECT {k}, 'weighted avg', {ratio(' + '.join(v[0] + '*' + v[3] for v in per.values()), S)}, "
                f"{ratio(' + '.join(v[1] + '*' + v[3] for v in per.values()), S)}, "
                f"{ratio(' + '.join(v[2] + '*' + v[3] for v in per.values()), S)}, {S} FROM g")
    rows.append(f"SELECT {k}, 'samples avg', s_p, s_r, s_f, {S} FROM g")
    return (f"g AS (SELECT {k}, {', '.join(aggs)} FROM {src} GROUP BY {k}),\n"
            f"rep AS ({' UNION ALL '.join(rows)})")


@register("classification_report", TD.with_views(TD.PREDICTED_SQL + ",\n" + _report_sql("predicted", ["ori_lang"]), """
SELECT ori_lang, row_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rep"""))
def q_classification_report(spark, sf):
    r = M.classification_report(TD.predicted(spark, sf), LABELS, ["ori_lang"])
    return r.select("ori_lang", "row_name", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), "support")


SEEDS = [1, 2, 3]


def _seeded_flip_sql(lab: str) -> str:
    return (f"CAST(CASE WHEN substr(md5(CAST(review_id AS VARCHAR) || '-{lab}-' || CAST(run_seed AS VARCHAR)), 1, 1) "
            f"IN ('0', '1', '2') THEN 1 - {lab} ELSE {lab} END AS INTEGER) AS pred_{lab}")


@register("average_runs", TD.with_views(
    TD.LABELLED_SQL + f""",
runs AS (SELECT *, unnest([{', '.join(map(str, SEEDS))}]) AS run_seed FROM labelled),
rp AS (SELECT *, {', '.join(_seeded_flip_sql(l) for l in LABELS)} FROM runs),
""" + _report_sql("rp", ["run_seed", "ori_lang"]), """
SELECT ori_lang, row_name, CAST(count(*) AS BIGINT) AS n_runs, round(avg(precision), 3) AS precision,
       round(avg(recall), 3) AS recall, round(avg(f1), 3) AS f1
FROM rep GROUP BY ori_lang, row_name"""))
def q_average_runs(spark, sf):
    l = TD.labelled(spark, sf).withColumn("run_seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    for lab in LABELS:
        h = F.substring(F.md5(F.concat_ws("-", F.col("review_id").cast("string"), F.lit(lab),
                                          F.col("run_seed").cast("string"))), 1, 1)
        l = l.withColumn(f"pred_{lab}", F.when(h.isin("0", "1", "2"), 1 - F.col(lab)).otherwise(F.col(lab)).cast("int"))
    rep = M.classification_report(l, LABELS, ["run_seed", "ori_lang"])
    return M.average_runs(rep, ("ori_lang", "row_name"), 3)


PROB_MULT = {"irrelevant": 37, "feature_request": 53, "problem_report": 71}


def _with_probs(df):
    for lab, m in PROB_MULT.items():
        df = df.withColumn(f"prob_{lab}", ((F.col("review_id") * m) % 101).cast("double") / 100.0)
    return df


def _probs_sql() -> str:
    return ", ".join(f"CAST((review_id * {m}) % 101 AS DOUBLE) / 100.0 AS prob_{lab}" for lab, m in PROB_MULT.items())


def _bce_term_sql(lab: str) -> str:
    p = f"prob_{lab}"
    return (f"-({lab} * (CASE WHEN {p} > 0 THEN greatest(ln({p}), -100) ELSE -100 END) + "
            f"(1 - {lab}) * (CASE WHEN {p} < 1 THEN greatest(ln(1 - {p}), -100) ELSE -100 END))")


@register("bce_loss", TD.with_views(TD.LABELLED_SQL + f""",
lp AS (SELECT *, {_probs_sql()} FROM labelled)""", f"""
SELECT ori_lang, round(avg(({' + '.join(_bce_term_sql(l) for l in LABELS)}) / 3.0), 6) AS loss,
       CAST(count(*) AS BIGINT) AS n
FROM lp GROUP BY ori_lang"""))
def q_bce_loss(spark, sf):
    r = M.bce_loss(_with_probs(TD.labelled(spark, sf)), LABELS, keys=["ori_lang"])
    return r.select("ori_lang", r6("loss").alias("loss"), "n")


@register("roc_auc", TD.with_views(TD.LABELLED_SQL + f""",
lp AS (SELECT *, {_probs_sql()} FROM labelled),
lo AS ({' UNION ALL '.join(f"SELECT '{l}' AS label, prob_{l} AS s, {l} AS y FROM lp" for l in LABELS)}),
rk AS (SELECT label, s, y, rank() OVER (PARTITION BY label ORDER BY s)
              + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0 AS r FROM lo)""", """
SELECT label, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
                    / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auroc
FROM rk GROUP BY label"""))
def q_roc_auc(spark, sf):
    r = M.roc_auc(_with_probs(TD.labelled(spark, sf)), LABELS)
    return r.select("label", r6("auroc").alias("auroc"))


# --------------------------------------------------------------------------
# Rating sheets (A13 → A8 → D12)

def _rating(idx: int):
    rid = F.col("review_id")
    return F.when((rid + idx) % 7 == 0, F.lit(0)).otherwise(1 + (rid + 2 * idx) % 5)


@register("likert_means", TD.with_views(TD.LABELLED_SQL + ",\nit AS (SELECT * FROM labelled WHERE ori_lang IN ('en', 'fr')),\n"
                                        "r AS (" + " UNION ALL ".join(
    f"SELECT ori_lang AS lang, '{d}' AS dimension, CASE WHEN (review_id + {i}) % 7 = 0 THEN 0 "
    f"ELSE 1 + (review_id + {2 * i}) % 5 END AS rating FROM it"
    for i, d in enumerate(M.DIMENSIONS)) + ")", """
SELECT lang, dimension, CAST(sum(rating) AS BIGINT) AS rating_sum,
       round(sum(rating) / (count(*) * 4 / 4.0), 2) AS mean
FROM r GROUP BY lang, dimension"""))
def q_likert_means(spark, sf):
    l = TD.labelled(spark, sf).where(F.col("ori_lang").isin("en", "fr"))
    items = l.select("app", F.col("ori_lang").alias("lang"),
                     F.when(F.col("feature_request") == 1, F.lit("feature_request"))
                     .otherwise(F.lit("problem_report")).alias("category"),
                     F.col("review_id").alias("item"), F.col("data").alias("document"),
                     F.col("data").alias("summary"),
                     *[_rating(i).alias(f"r_{d}") for i, d in enumerate(M.DIMENSIONS)])
    sheet = LK.likert_sheet(items, {d: f"r_{d}" for d in M.DIMENSIONS})
    marks = LK.parse_likert(sheet)
    return M.likert_means(marks, ["lang"]).select("lang", "dimension", "rating_sum", "mean")
