"""Model clients: retries, error rows, chat and system text, resume."""
import pytest
from pyspark.sql import functions as F

from critica.operators.joins import pending
from critica.operators.summarize import call_client
from critica.operators.zero_shot import StubClientFactory, annotate


def flaky_factory():
    class Flaky:
        """Fails on every batch and on the first try of each prompt; never answers prompts with ``bad``."""
        factory = True

        def __call__(self):
            seen = set()

            def ask(prompts):
                if len(prompts) > 1:
                    raise TimeoutError("batch")
                p = prompts[0]
                if "bad" in p:
                    raise RuntimeError("refused")
                if p not in seen:
                    seen.add(p)
                    raise TimeoutError("first try")
                return [p.upper()]
            return ask

    return Flaky()


def test_flaky_client_loses_and_repeats_nothing(spark):
    prompts = spark.createDataFrame([(i, f"prompt {i}" + (" bad" if i % 5 == 0 else "")) for i in range(20)], "id long, prompt string")
    rows = call_client(prompts, flaky_factory(), "prompt", "answer", "error", retries=2, wait=0.0, system="Be kind.").collect()
    assert sorted(r.id for r in rows) == list(range(20))
    for r in rows:
        if r.id % 5 == 0:
            assert r.answer is None and r.error == "RuntimeError: refused"
        else:
            assert r.answer == f"BE KIND.\nPROMPT {r.id}" and r.error is None
    with pytest.raises(Exception):
        call_client(prompts, flaky_factory(), "prompt", "answer", retries=1, wait=0.0).collect()


def test_error_rows_are_asked_again(spark):
    reviews = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "review_id long, data string")
    stored = spark.createDataFrame([(1, "m", "x", None), (2, "m", None, "TimeoutError: x")],
                                   "review_id long, model string, result string, error string")
    assert sorted(r.review_id for r in pending(reviews, stored, "m").collect()) == [2, 3]


def test_chat_prompts(spark):
    reviews = spark.createDataFrame([(1, "it crashes", "en", "app")], "review_id long, data string, ori_lang string, app string")

    class Echo:
        factory = True
        def __call__(self):
            return lambda prompts: prompts

    r = annotate(reviews, Echo(), "m", chat=True, error_col="error").first()
    assert r.result.startswith("### Human: ") and r.result.endswith(" ### Assistant:") and r.error is None
    assert annotate(reviews, StubClientFactory(), "m").where(F.col("result").isNotNull()).count() == 1
