"""Zero-shot labelling with an injected model client.

prompt table → reviews still pending for the model → client calls in
Arrow batches on the executors → answers appended → routed.  Nothing
networked ships here; the client is a factory the caller provides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.functions.prompts import chat_turn, classify_prompt
from critica.operators.joins import pending
from critica.operators.routing import language_name, route_by_text
from critica.operators.summarize import KeywordStubClient, call_client


class StubClientFactory:
    """Zero-argument factory of the deterministic offline client (built once per worker)."""
    factory = True

    def __call__(self):
        return KeywordStubClient()


def classify_prompts(reviews: DataFrame, text_col: str = "data") -> DataFrame:
    """(review_id, lang_name, prompt): language from ``ori_lang`` or detected."""
    named = language_name(reviews, text_col)
    return named.select("review_id", "lang_name",
                        classify_prompt(F.col("lang_name"), F.coalesce(F.col(text_col), F.lit(""))).alias("prompt"))


def annotate(reviews: DataFrame, client, model: str, responses: DataFrame | None = None,
             batch_rows: int | None = None, chat: bool = False, error_col: str | None = None, **options) -> DataFrame:
    """New answers (review_id, model, lang_name, result) for reviews not yet answered by ``model``.

    ``chat``: prompts in the chat-turn form of locally hosted models (H6).
    ``error_col``: a column with the error of each unanswered prompt; such
    rows are no answers, so ``pending`` asks them again.  Other options go
    to ``call_client``.
    """
    todo = reviews if responses is None else pending(reviews, responses, model)
    prompts = classify_prompts(todo)
    if chat:
        prompts = prompts.withColumn("prompt", chat_turn(F.col("prompt")))
    if batch_rows:
        n = max(1, int(todo.count() // batch_rows) + 1)
        prompts = prompts.repartition(n)
    answered = call_client(prompts, client, "prompt", "result", error_col, **options)
    return answered.select("review_id", F.lit(model).alias("model"), "lang_name", "result",
                           *([error_col] if error_col else []))


def zero_shot(reviews: DataFrame, client, model: str, responses: DataFrame | None = None) -> DataFrame:
    """Answers (stored + new) routed into the three categories."""
    new = annotate(reviews, client, model, responses)
    if responses is not None:
        new = responses.where(F.col("model") == model).select(*new.columns).unionByName(new)
    return route_by_text(new, "result")
