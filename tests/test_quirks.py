"""Semantics decisions of SURVEY §1.4 that are not covered elsewhere."""
import pytest
from pyspark.sql import functions as F

from critica.functions import text as TX
from critica.operators import routing as RT
from critica.operators import summarize as SU
from critica.schema import REPORT, REVIEW


def test_q2_abstractive_rounds_must_shrink(spark):
    # Every item is over the budget: a round cannot shrink the group.
    rows = [("g", i, " ".join(["w"] * 50)) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, review_id long, data string")

    class Echo:
        def __call__(self, prompts):
            return [" ".join(["x"] * 50) for _ in prompts]
    with pytest.raises(RuntimeError):
        SU.abstractive_summary(df, ["k"], Echo(), budget=10, max_rounds=3)


def test_q8_missing_text_becomes_empty_and_flagged(spark):
    df = spark.createDataFrame([(1, None), (2, "ok")], "review_id long, data string")
    got = {r.review_id: (r.data, r.data_missing) for r in RT.coerce_text(df).collect()}
    assert got == {1: ("", True), 2: ("ok", False)}


def test_q17_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.50001,), (0.2,)], "p double")
    got = [r.pred_p for r in RT.threshold_labels(df, ["p"]).collect()]
    assert got == [0, 1, 0]


def test_b13_ensure_columns(spark):
    df = spark.createDataFrame([("text", 3, 1)], "data string, score int, thumbsUpCount long")
    out = RT.ensure_columns(df, REVIEW)
    r = out.first()
    assert r.app == "app" and r.result is None and r.ori_lang is None
    assert dict(out.dtypes)["review_id"] == "bigint"


def test_q5_language_name_uses_ori_lang(spark):
    df = spark.createDataFrame([(1, "fr", "the and is of to"), (2, None, "le la les des est et")],
                               "review_id long, ori_lang string, data string")
    got = {r.review_id: r.lang_name for r in RT.language_name(df).collect()}
    assert got == {1: "French", 2: "French"}


def test_h19_report_json_round_trip(spark):
    rep = spark.createDataFrame([("A", 3, (1, [("s", 2.5, 1, ["r"])]), (0, []), (2,))], REPORT)
    back = rep.select(TX.report_from_json(TX.report_to_json(F.struct(*rep.columns))).alias("r")).select("r.*")
    assert back.collect() == rep.collect()


def test_review_ids_stable_and_distinct(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('data,ground_truth,score,thumbsUpCount,problem_report,feature_request,irrelevant,ori_lang,app\n'
                 '"same, text",1,1,0,1,0,0,en,X\n"same, text",1,1,0,1,0,0,en,X\n"other ""q""",2,5,3,1,0,0,fr,X\n')
    from critica.sources.files import read_reviews
    a = sorted(r.review_id for r in read_reviews(spark, str(p)).collect())
    b = sorted(r.review_id for r in read_reviews(spark, str(p)).collect())
    assert a == b and len(set(a)) == 3
    assert read_reviews(spark, str(p)).where(F.col("data") == 'other "q"').count() == 1
