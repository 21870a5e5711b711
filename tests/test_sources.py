"""Sources and sinks on a small review corpus of our own."""
import csv

import pytest
from pyspark.sql import functions as F

from critica.operators import aggregates as AG
from critica.sources import files as FS

FIELDS = ["data", "ground_truth", "score", "thumbsUpCount", "problem_report", "feature_request", "irrelevant",
          "ori_lang", "app"]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """<root>/<app>/<category>.csv with quotes, commas, line ends and missing clusters."""
    root = tmp_path_factory.mktemp("corpus")
    for app in ("Step Counter", "Sleep"):
        (root / app).mkdir()
        for category in ("problem_report", "feature_request"):
            with open(root / app / f"{category}.csv", "w", newline="", encoding="utf-8") as f:
                w = csv.DictWriter(f, FIELDS)
                w.writeheader()
                for i in range(12):
                    text = [f'It says "no, {i}" again', f"première ligne\nseconde {i}", f"crash {i}, crash"][i % 3]
                    w.writerow({"app": app, "ori_lang": ["en", "fr"][i % 3 == 1], "data": text, "score": 1 + i % 5,
                                "thumbsUpCount": i, "problem_report": int(category == "problem_report"),
                                "feature_request": int(category == "feature_request"), "irrelevant": 0,
                                "ground_truth": "" if i == 11 else i // 5})
    return root


def test_read_reviews_shape(spark, corpus):
    df = FS.read_reviews(spark, str(corpus / "Sleep" / "problem_report.csv"))
    assert df.count() == 12 and df.select("review_id").distinct().count() == 12
    r = df.agg(F.sum("problem_report"), F.sum("feature_request"), F.count_distinct("ori_lang")).first()
    assert tuple(r) == (12, 0, 2)
    assert {x.data for x in df.where(F.col("data").contains("première")).collect()} == {f"première ligne\nseconde {i}" for i in (1, 4, 7, 10)}


def test_read_corpus_path_columns(spark, corpus):
    df = FS.read_corpus(spark, str(corpus))
    assert df.count() == 48
    assert sorted((r.app_folder, r.category) for r in df.select("app_folder", "category").distinct().collect()) == [
        (a, c) for a in ("Sleep", "Step Counter") for c in ("feature_request", "problem_report")]


def test_ground_truth_goldens(spark, corpus):
    df = FS.read_reviews(spark, str(corpus / "Sleep" / "problem_report.csv"))
    st = AG.cluster_size_stats(df, ["app"], "ground_truth", 5).first()
    assert (st.n_clusters, st.n_large, st.n_in_large) == (3, 2, 10)
    imp = {r.ground_truth: r.importance for r in AG.cluster_importance(df, ["app"], "ground_truth").collect()}
    assert imp[0] == pytest.approx((5 + 0.1 * 10) / 3) and imp[2] == pytest.approx((1 + 0.1 * 10) / 1)


def test_read_named_is_one_scan_with_names(spark, corpus):
    df = FS.read_named(spark, str(corpus / "Sleep"), ["problem_report", "feature_request"])
    assert {(r.dataset, r["count"]) for r in df.groupBy("dataset").count().collect()} == {
        ("problem_report", 12), ("feature_request", 12)}


def test_read_responses_keeps_answer_lines(spark, tmp_path):
    with open(tmp_path / "answers.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(FIELDS + ["result"])
        w.writerow(["text", 1, 5, 0, 1, 0, 0, "en", "Sleep", "Feature Request: none\nProblem Report: it \"stops\"\n"])
    r = FS.read_responses(spark, str(tmp_path / "answers.csv")).collect()
    assert [x.result for x in r] == ["Feature Request: none\nProblem Report: it \"stops\"\n"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_table_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "b", c', "x"), (2, "é", "y")], "review_id long, data string, split string")
    FS.write_table(df, str(tmp_path / fmt), fmt, ["split"])
    back = spark.read.schema(df.schema)
    back = back.parquet(str(tmp_path / fmt)) if fmt == "parquet" else back.option("header", True).option("escape", '"').csv(str(tmp_path / fmt))
    assert sorted(tuple(r) for r in back.collect()) == [(1, 'a "b", c', "x"), (2, "é", "y")]
    assert sorted(x.name for x in (tmp_path / fmt).iterdir() if x.is_dir()) == ["split=x", "split=y"]


def test_run_logs(spark, tmp_path):
    d = tmp_path / "logs" / "bert-Garmin-Huawei-2024" / "log.log"
    d.parent.mkdir(parents=True)
    d.write_text("10:00:00,1 root INFO App: ['Garmin']\n10:00:00,2 root INFO Original language: en\n"
                 "10:00:00,3 root INFO Size of test set: 6\n10:00:00,4 root INFO               precision    recall  f1-score   support\n\n"
                 "     irrelevant   1.000000  0.500000  0.666667         2\n"
                 "   weighted avg   0.666667  0.500000  0.555556         6\n"
                 "10:00:01,1 root INFO Original language: fr\n"
                 "     irrelevant   0.500000  0.500000  0.500000         2\n")
    rows = FS.read_run_logs(spark, str(tmp_path / "logs"), ["bert"]).orderBy("ori_lang", "row_name").collect()
    got = [(r.ori_lang, r.row_name, r.precision, r.support) for r in rows]
    assert got == [("en", "irrelevant", 1.0, 2), ("en", "weighted avg", 0.666667, 6), ("fr", "irrelevant", 0.5, 2)]
