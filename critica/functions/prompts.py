"""Prompt text for injected model clients (H6, H7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instruction texts of the classify and summarise prompts.
CLASSIFY_INSTRUCTION = ("Classify the following {lang} app review into problem report, "
                        "feature request or irrelevant. Be concise.")
SUMMARY_INSTRUCTION = "Please summarize all following app reviews into one English sentence"
SUMMARY_SYSTEM = "You are a helpful assistant that summarizes app reviews."


def classify_prompt(lang_name, review) -> Column:
    """Plain classify prompt: instruction with the language, then the fenced review."""
    head = F.replace(F.lit(CLASSIFY_INSTRUCTION), F.lit("{lang}"), lang_name)
    return F.concat(head, F.lit("\n```\n"), review, F.lit("\n```"))


def chat_turn(prompt) -> Column:
    """Chat-turn wrapper used with locally hosted models."""
    return F.concat(F.lit("### Human: "), prompt, F.lit(" ### Assistant:"))


def summary_prompt(reviews_array) -> Column:
    """Instruction plus a fenced bullet list of the reviews."""
    bullets = F.array_join(F.transform(reviews_array, lambda r: F.concat(F.lit("- "), r)), "\n")
    return F.concat(F.lit(SUMMARY_INSTRUCTION + "\n```\n"), bullets, F.lit("\n```"))
