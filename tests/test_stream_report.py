"""Streaming equals batch; report assembly and flattening; sheet file round trip."""
import os
import tempfile

from pyspark.sql import functions as F

from critica.operators import aggregates as AG
from critica.operators import likert as LK
from critica.operators import metrics as M
from critica.operators import routing as RT
from critica.operators.zero_shot import StubClientFactory
from critica.plans import analyze as A
from critica.sources import files as FS
from critica.sources import testdata as TD
from critica.streaming.annotate import stream_annotate, stream_category_counts

SF = "/root/testdata/sf0.001"


def _scratch():
    return tempfile.mkdtemp(prefix="critica-test-", dir="/tmp")


def test_stream_counts_equal_batch(spark):
    d = _scratch()
    ans = TD.answers(spark, SF)
    ans.repartition(3).write.parquet(f"{d}/src")
    stream_category_counts(spark, f"{d}/src", ans.schema, "critica_counts")
    got = sorted(map(tuple, spark.sql("SELECT * FROM critica_counts").collect()))
    want = sorted(map(tuple, AG.category_counts(RT.route_by_text(ans)).collect()))
    assert got == want


def test_stream_annotate_resumes_without_duplicates(spark):
    d = _scratch()
    rev = TD.reviews(spark, SF)
    rev.where("review_id < 100").write.parquet(f"{d}/src/part1")
    schema = rev.schema
    stream_annotate(spark, f"{d}/src/*", schema, StubClientFactory(), "stub", f"{d}/out", f"{d}/ckpt")
    rev.where("review_id >= 100").write.parquet(f"{d}/src/part2")
    stream_annotate(spark, f"{d}/src/*", schema, StubClientFactory(), "stub", f"{d}/out", f"{d}/ckpt")
    out = spark.read.parquet(f"{d}/out")
    assert out.count() == rev.count()
    assert out.select("review_id").distinct().count() == rev.count()


def test_report_assembly_and_flatten(spark):
    counts = spark.createDataFrame([("A", 10, 4, 3, 3, 0)], "app string, n_reviews long, n_feature_request long, "
                                   "n_problem_report long, n_irrelevant long, n_unrouted long")
    clusters = spark.createDataFrame([("A", "pro", 1, 0, "s0", 5.0, 2), ("A", "pro", 2, 1, "s1", 2.0, 1)],
                                     "app string, category string, cluster_rank int, clusters int, summary string, "
                                     "importance double, count long")
    reviews = spark.createDataFrame([("A", "pro", 0, 2, 11, "r2", 0.1), ("A", "pro", 0, 1, 10, "r1", 0.9),
                                     ("A", "pro", 1, 1, 12, "r3", 0.5)],
                                    "app string, category string, clusters int, review_rank long, review_id long, "
                                    "data string, similarity double")
    rep = A.assemble_report(counts, clusters, reviews).first()
    assert rep["count"] == 10 and rep.irrelevant["count"] == 3
    pro = rep.problem_report["clusters"]
    assert [c["summary"] for c in pro] == ["s0", "s1"] and pro[0]["reviews"] == ["r1", "r2"]
    assert rep.feature_request["clusters"] == []
    d = _scratch()
    FS.write_report(A.assemble_report(counts, clusters, reviews), f"{d}/reports")
    back = FS.read_reports(spark, f"{d}/reports")
    flat = A.flatten_report(back).orderBy("cluster_pos", "review_pos").collect()
    assert [(r.cluster_pos, r.review_pos, r.review) for r in flat] == [(0, 0, "r1"), (0, 1, "r2"), (1, 0, "r3")]


def test_sheet_file_round_trip(spark):
    items = spark.createDataFrame([("Huawei Health", "en", "problem_report", 0, "a ||||| b", "sum", 5, 3, 2, 0),
                                   ("Huawei Health", "en", "problem_report", 1, "c", "sum2", 3, 3, 0, 1)],
                                  "app string, lang string, category string, item long, document string, "
                                  "summary string, r1 int, r2 int, r3 int, r4 int")
    sheet = LK.likert_sheet(items, dict(zip(M.DIMENSIONS, ["r1", "r2", "r3", "r4"])))
    d = _scratch()
    FS.write_sheet(sheet, f"{d}/sheet")
    lines = LK.read_sheet_lines(spark, f"{d}/sheet/*")
    got = {r.dimension: r.mean for r in M.likert_means(LK.parse_likert(lines)).collect()}
    assert got == {"Relevance": 4.0, "Consistency": 3.0, "Fluency": 1.0, "Coherence": 0.5}
