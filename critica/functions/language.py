"""Language detection from function-word hits (H17, variant a).

A built-in-only detector: count how many tokens of a text fall in each
language's word list; the language with most hits wins, ties go to the
earlier language in ``LANGS`` (English first).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from critica.functions.text import tokenize

# Short function-word lists per language (own selection).
FUNCTION_WORDS = {
    "en": ["the", "and", "is", "are", "was", "of", "to", "in", "it", "that", "this", "with",
           "for", "on", "not", "you", "have", "be", "but", "they"],
    "fr": ["le", "la", "les", "des", "est", "et", "un", "une", "du", "de", "que", "qui",
           "pour", "pas", "dans", "sur", "avec", "ce", "il", "je", "ne", "en"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "mit", "ich",
           "sie", "es", "auf", "den", "dem", "von", "für", "sich", "auch"],
    "es": ["el", "los", "las", "es", "un", "una", "que", "de", "en", "por", "con", "para",
           "no", "se", "lo", "del", "al", "muy", "pero"],
}
LANGS = ["en", "fr", "de", "es"]


def _hits(tokens: Column, lang: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*FUNCTION_WORDS[lang])))


def detect_language(text, langs=None) -> Column:
    """Code of the language with most function-word hits; ties → earlier in the list.

    The text is tokenised once and each language's hits are counted once:
    one-element arrays hold both.
    """
    langs = list(langs or LANGS)

    def best(hits: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(hits, F.array_max(hits)).cast("int"))

    counted = F.transform(F.array(tokenize(text)), lambda t: F.array(*[_hits(t, lang) for lang in langs]))
    return F.get(F.transform(counted, best), F.lit(0))


def is_english(text) -> Column:
    """English vs French decision used by the extractive summariser."""
    return detect_language(text, ["en", "fr"]) == "en"
