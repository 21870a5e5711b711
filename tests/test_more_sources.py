"""Embedded-record and clustered-output sources, metrics table, plug-in scorer."""
import tempfile

from pyspark.sql import functions as F

from critica.operators import classify as K
from critica.operators import metrics as M
from critica.sources import files as FS


def _scratch():
    return tempfile.mkdtemp(prefix="critica-test-", dir="/tmp")


def test_embedded_round_trip(spark):
    d = _scratch()
    rows = [("text a", 1, 2, 0, 1, 0, 0, "en", "App", [0.1, 0.2], [0.3], [0.4, 0.5])]
    schema = ("data string, ground_truth int, score int, thumbsUpCount long, problem_report int, "
              "feature_request int, irrelevant int, ori_lang string, app string, embedding array<double>, "
              "`20_dim_embedding` array<double>, `2_dim_embedding` array<double>")
    df = spark.createDataFrame(rows, schema)
    FS.write_embedded(df, f"{d}/emb")
    back = FS.read_embedded(spark, f"{d}/emb").first()
    assert back.embedding == [0.1, 0.2] and back["2_dim_embedding"] == [0.4, 0.5] and back.app == "App"


def test_read_clustered_tree(spark):
    import os
    d = _scratch()
    folder = f"{d}/out/hdbscan-e5-0.0/Some App"
    os.makedirs(folder)
    with open(f"{folder}/problem_report.csv", "w") as f:
        f.write('data,ground_truth,clusters,ori_lang,app\n"x, y",1,0,en,Some App\nz,2,-1,fr,Some App\n')
    with open(f"{folder}/notes.txt", "w") as f:  # non-CSV files are skipped
        f.write("x")
    back = FS.read_clustered(spark, f"{d}/out").orderBy("ground_truth").collect()
    assert [(r.run, r.app_folder, r.category, r.data, r.clusters) for r in back] == [
        ("hdbscan-e5-0.0", "Some App", "problem_report", "x, y", 0),
        ("hdbscan-e5-0.0", "Some App", "problem_report", "z", -1)]


def test_metrics_table(spark):
    m = spark.createDataFrame([("e", "feature_request", 0.5, 0.4, 0.45), ("e", "feature_request", 0.7, 0.6, 0.65),
                               ("e", "weighted avg", 0.6, 0.6, 0.6)],
                              "experiment string, row_name string, precision double, recall double, f1 double")
    r = M.metrics_table(m, ["experiment"]).first()
    assert r["feature_request_p"] == 0.6 and r["weighted avg_f"] == 0.6


def test_plugin_scorer(spark):
    class Factory:
        def __call__(self):
            return lambda texts: [[0.9 if "bug" in t else 0.1, 0.5, 0.51] for t in texts]
    df = spark.createDataFrame([(1, "a bug here"), (2, "nice")], "review_id long, data string")
    got = {r.review_id: (r.pred_irrelevant, r.pred_feature_request, r.pred_problem_report)
           for r in K.predict_with_model(df, Factory()).collect()}
    assert got == {1: (1, 0, 1), 2: (0, 0, 1)}
