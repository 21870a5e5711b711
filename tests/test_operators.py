"""Operator goldens on hand fixtures (values worked out on paper)."""
import math

import pytest

from tests import reference_kernels as R
from pyspark.sql import functions as F

from critica.functions import text as TX
from critica.operators import aggregates as AG
from critica.operators import metrics as M
from critica.operators import routing as RT
from critica.operators import similarity as SI
from critica.operators import split as SP
from critica.operators import summarize as SU
from critica.schema import LABELS


def test_route_by_text(spark):
    df = spark.createDataFrame([(1, "Problem Report"), (2, "FEATURE REQUEST and problem report"),
                                (3, "irrelevant"), (4, "unclear"), (5, None)], "review_id long, result string")
    got = {r.review_id: (r.is_fea, r.is_pro, r.is_irr) for r in RT.route_by_text(df).collect()}
    assert got == {1: (False, True, False), 2: (True, True, False), 3: (False, False, True),
                   4: (False, False, False), 5: (False, False, False)}
    assert sorted((r.review_id, r.category) for r in RT.route_long(df).collect()) == \
        [(1, "pro"), (2, "fea"), (2, "pro"), (3, "irr")]


def test_structured_answer(spark):
    rows = ["Feature Request: Add sync\n", "feature request: add\n", "Feature Request: None\n",
            "Feature Request: Notify me\n", "Feature Request: Add", "Feature Request: Add\r sync\n"]
    df = spark.createDataFrame(list(enumerate(rows)), "review_id long, result string")
    got = [r.pred_feature_request for r in RT.parse_structured_answer(df).orderBy("review_id").collect()]
    assert got == [1, 1, 0, 0, 0, 1]


def test_importance(spark):
    df = spark.createDataFrame([("a", "pro", 0, 1, 0), ("a", "pro", 0, 2, 5), ("a", "pro", 0, 3, 5),
                                ("a", "pro", -1, 1, 100), ("a", "pro", 1, None, 1)],
                               "app string, category string, clusters int, score int, thumbsUpCount long")
    got = {r.clusters: r.importance for r in AG.cluster_importance(df).collect()}
    assert got == {0: 2.0, 1: None}


def test_chunks():
    assert R._chunk_ids([5, 6, 3, 20, 1], 10) == [0, 1, 1, 2, 3]
    assert R._chunk_ids([20, 1], 10) == [0, 1]


def test_chunk_by_budget_grouped(spark):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate([5, 6, 3, 20, 1])],
                               "k string, review_id long, n_tokens long")
    got = [r.chunk for r in SU.chunk_by_budget(df, ["k"], 10).orderBy("review_id").collect()]
    assert got == [0, 1, 1, 2, 3]


def test_nmi_ari(spark):
    truth = [0, 0, 0, 1, 1, 1, 2, 2]
    pred = [0, 0, 1, 1, 1, 1, -1, -1]
    df = spark.createDataFrame(list(zip(truth, pred)), "t int, p int")
    r = M.nmi(df, "t", "p").first()
    assert round(r.mi, 6) == 0.801028 and round(r.h_truth, 6) == 1.082196
    assert round(r.h_pred, 6) == 1.039721 and round(r.nmi, 6) == 0.755004
    assert round(M.adjusted_rand(df, "t", "p").first().ari, 6) == 0.545455
    perm = spark.createDataFrame(list(zip(truth, [7 if x == 0 else 3 if x == 1 else 9 for x in pred])), "t int, p int")
    assert round(M.nmi(perm, "t", "p").first().nmi, 6) == 0.755004
    one = spark.createDataFrame([(1, 1), (1, 1)], "t int, p int")
    assert M.nmi(one, "t", "p").first().nmi == 1.0


def test_classification_report(spark):
    true = ["100", "011", "001", "010", "100", "000"]
    pred = ["100", "010", "011", "000", "001", "000"]
    rows = [tuple(int(c) for c in t) + tuple(int(c) for c in p) for t, p in zip(true, pred)]
    df = spark.createDataFrame(rows, ", ".join(f"{l} int" for l in LABELS) + ", " +
                               ", ".join(f"pred_{l} int" for l in LABELS)).withColumn("g", F.lit(1))
    got = {r.row_name: (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6), r.support)
           for r in M.classification_report(df, LABELS, ["g"]).collect()}
    assert got["irrelevant"] == (1.0, 0.5, 0.666667, 2)
    assert got["feature_request"] == (0.5, 0.5, 0.5, 2)
    assert got["micro avg"] == (0.6, 0.5, 0.545455, 6)
    assert got["macro avg"] == (0.666667, 0.5, 0.555556, 6)
    assert got["weighted avg"] == (0.666667, 0.5, 0.555556, 6)
    assert got["samples avg"] == (0.416667, 0.416667, 0.388889, 6)


def test_loss_and_auroc(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.6), (0, 0.6)], "y int, prob_y double")
    assert round(M.bce_loss(df, ["y"]).first().loss, 6) == 0.438905
    assert round(M.roc_auc(df, ["y"]).first().auroc, 6) == 0.875


def test_smoothed_idf():
    n = 4
    got = [round(math.log((n + 1) / (d + 1)) + 1, 6) for d in (1, 2, 3, 4)]
    assert got == [1.916291, 1.510826, 1.223144, 1.0]


def test_document_frequency_bounds(spark):
    tf = spark.createDataFrame([(d, t, 1) for d, terms in enumerate(["a b c", "a b", "a", "x"])
                                for t in terms.split()], "review_id long, term string, tf long")
    voc = {r.term for r in SP_df(spark, tf)}
    assert voc == {"b"}


def SP_df(spark, tf):
    from critica.operators.features import document_frequency
    nd = spark.createDataFrame([(4,)], "n_docs long")
    return document_frequency(tf, [], min_df=2, max_df=0.5, n_docs=nd).collect()


def test_centrality(spark):
    # Term-count vectors equal to the fixture's unit vectors: (1,0), (.6,.8), (0,1)
    sents = spark.createDataFrame([("g", 1, 0, "aa aa aa"), ("g", 2, 0, "aa aa aa bb bb bb bb"), ("g", 3, 0, "bb")],
                                  "k string, review_id long, sent_id int, sentence string")
    got = {r.review_id: round(r.centrality, 6) for r in SI.sentence_centrality(sents, ["k"]).collect()}
    assert got == {1: 1.6, 2: 2.4, 3: 1.8}


def test_tokens_sentences_words(spark):
    df = spark.createDataFrame([("Déçu été a b2", "Hello there. How are you?  Ok\nNew")], "t string, s string")
    r = df.select(TX.tokenize("t").alias("tok"), TX.split_sentences("s").alias("sents"),
                  TX.word_count(F.lit("un deux trois")).alias("wc")).first()
    assert r.tok == ["déçu", "été", "b2"]
    assert r.sents == ["Hello there.", "How are you?", "Ok", "New"]
    assert r.wc == 3


def test_run_name(spark):
    method, eps = TX.parse_run_name(F.lit("hdbscan-multilingual-e5-0.0"))
    r = spark.range(1).select(method.alias("m"), eps.alias("e")).first()
    assert (r.m, r.e) == ("multilingual-e5", 0.0)


def test_ratings(spark):
    marks = spark.createDataFrame(
        [("en", "Relevance", 5), ("en", "Relevance", 3), ("en", "Fluency", 2), ("en", "Fluency", 0),
         ("en", "Consistency", 1), ("en", "Consistency", 1), ("en", "Coherence", 1), ("en", "Coherence", 1)],
        "lang string, dimension string, rating int")
    got = {r.dimension: r.mean for r in M.likert_means(marks).collect()}
    assert got["Relevance"] == 4.0 and got["Fluency"] == 1.0


def test_split_sizes(spark):
    rows = [(i, "f", 0, 0, 1) for i in range(10)] + [(100 + i, "f", 0, 1, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "review_id long, dataset string, irrelevant int, feature_request int, "
                                     "problem_report int")
    s = SP.stratified_split(df, LABELS, 0.2, 0.2, seed=1)
    c = {(r.feature_request, r.split): r["count"] for r in s.groupBy("feature_request", "split").count().collect()}
    assert c == {(0, "test"): 2, (0, "valid"): 2, (0, "train"): 6, (1, "test"): 1, (1, "valid"): 1, (1, "train"): 3}
    assert s.count() == 15 and s.select("review_id").distinct().count() == 15
    again = SP.stratified_split(df, LABELS, 0.2, 0.2, seed=1)
    assert sorted(map(tuple, s.select("review_id", "split").collect())) == \
        sorted(map(tuple, again.select("review_id", "split").collect()))


def test_distributed_rank_hot_group(spark):
    from critica.operators.ranking import distributed_rank
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 7).cast("string")).alias("k"), F.col("id"))
    r = distributed_rank(df, ["k"], ["id"], "rn", num_partitions=16)
    hot = [x.rn for x in r.where("k = 'hot'").orderBy("id").collect()]
    assert hot == list(range(1, 1001))


@pytest.mark.parametrize("n_words", [8])
def test_abstractive_summary_rounds(spark, n_words):
    rows = [("g", i, " ".join(f"w{i}_{j}" for j in range(30))) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, review_id long, data string")
    s = SU.abstractive_summary(df, ["k"], SU.KeywordStubClient(n_words), budget=100).collect()
    assert len(s) == 1 and s[0].rounds == 2 and s[0].summary.startswith("4 reviews:")


def test_chunk_distributed_matches_greedy(spark):
    import random
    rnd = random.Random(4)
    rows, want = [], {}
    for g in ("a", "b"):
        toks = [rnd.choice([0, 1, 3, 5, 9, 12, 30]) for _ in range(60)]
        ids = list(range(len(toks)))
        for i, t in zip(ids, toks):
            rows.append((g, i, t))
        for i, c in zip(ids, R._chunk_ids(toks, 20)):
            want[(g, i)] = c
    df = spark.createDataFrame(rows, "k string, review_id long, n_tokens long")
    got = {(r.k, r.review_id): r.chunk for r in SU.chunk_by_budget(df, ["k"], 20).collect()}
    assert got == want


def test_distributed_ffill_sparse_hot_group(spark):
    import pandas as pd
    from critica.operators.ranking import distributed_ffill
    rows = [("hot" if i % 4 else f"k{i % 3}", i, (f"v{i}" if i % 397 == 5 else None)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos long, val string")
    got = {(r.k, r.pos): r.filled for r in
           distributed_ffill(df, ["k"], ["pos"], "val", "filled", num_partitions=16).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "pos", "val"]).sort_values(["k", "pos"])
    pdf["filled"] = pdf.groupby("k")["val"].ffill()
    want = {(k, p): (None if pd.isna(f) else f) for k, p, f in zip(pdf.k, pdf.pos, pdf.filled)}
    assert got == want
