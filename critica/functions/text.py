"""Column expressions over review text.  All JVM-side built-ins (codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace class used for word splitting.  Python's str.split()
# treats these as spaces; Java's \s alone does not know the Unicode ones.
WS_CLASS = r"\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}"
# Token pattern of the term vectoriser (Unicode words of 2+ chars).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Sentence-final punctuation followed by whitespace ends a sentence.
SENTENCE_END = r"([.!?\x{2026}])\s+"
# Separator of the reviews inside one summary document.
DOC_SEPARATOR = " ||||| "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_text(c) -> Column:
    """Any value as text; missing text becomes the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def tokenize(c) -> Column:
    """Lower-cased Unicode word tokens of at least two characters (H1)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0)


def word_count(c) -> Column:
    """Whitespace-separated word count, Unicode spaces included."""
    return F.size(F.regexp_extract_all(_c(c), F.lit(f"[^{WS_CLASS}]+"), 0))


def split_sentences(c) -> Column:
    """Array of trimmed, non-empty sentences (H3)."""
    marked = F.regexp_replace(_c(c), SENTENCE_END, "$1\n")
    parts = F.split(marked, "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def join_document(reviews_array) -> Column:
    """Reviews of one group as one document (H8)."""
    return F.array_join(_c(reviews_array), DOC_SEPARATOR)


def split_document(c) -> Column:
    """Inverse of ``join_document``: trimmed reviews of a document (H8)."""
    return F.transform(F.split(_c(c), r"\|\|\|\|\|"), lambda s: F.trim(s))


def category_prefix(stem) -> Column:
    """First three characters of a category file stem: ``pro`` / ``fea`` (H9)."""
    return F.substring(_c(stem), 1, 3)


def app_slug(app) -> Column:
    """App name usable in a file name."""
    return F.replace(_c(app), F.lit(" "), F.lit("-"))


def token_count(c) -> Column:
    """Default token estimate used for the summary budget (H5)."""
    return word_count(c)


def language_name(code) -> Column:
    """``en`` → English, ``fr`` → French, otherwise null (caller falls back)."""
    code = _c(code)
    return (F.when(code == "en", F.lit("English"))
            .when(code == "fr", F.lit("French")))


def matches_answer_label(c, label_text: str) -> Column:
    """Case-insensitive substring test of a model answer; null answers give false."""
    return F.coalesce(F.lower(_c(c)).contains(label_text.lower()), F.lit(False))


# Answer-form patterns of a structured model answer.  The ``d``
# flag makes ``.`` stop only at ``\n``, as in Python's regex engine.
FEATURE_ANSWER = r"(?id)Feature Request: (?!(No|Non|None|Irrelevant|N/A)).*\n"
PROBLEM_ANSWER = r"(?id)Problem Report: (?!(No|Non|None|Irrelevant|N/A)).*\n"
IRRELEVANT_ANSWER = r"(?i)Irrelevant: (Yes|Oui|Irrelevant)"
REQUEST_TEXT = r"(?d)Feature Request:(.{12,}|yes)\n"


def extract_request_text(c) -> Column:
    """Text after ``Feature Request:`` when it is long or ``yes``."""
    return F.regexp_extract(_c(c), REQUEST_TEXT, 1)


def parse_run_name(c):
    """``<algo>-<method...>-<eps>`` → (method, eps) columns."""
    parts = F.split(_c(c), "-")
    method = F.array_join(F.slice(parts, 2, F.size(parts) - 2), "-")
    eps = F.element_at(parts, -1).cast("double")
    return method, eps


def likert_mark(line) -> Column:
    """Sum of (cell index - 1) over the table cells holding an X."""
    cells = F.split(_c(line), r"\|")
    return F.aggregate(
        F.transform(cells, lambda cell, i: F.when(cell.rlike("[Xx]"), i - 1).otherwise(F.lit(0))),
        F.lit(0), lambda acc, v: acc + v)


def run_name(name: str, files_col) -> Column:
    """``<name>-<sorted distinct first words of the file names>`` (H11); the
    run timestamp is kept in its own column by the caller."""
    prefixes = F.array_sort(F.array_distinct(F.transform(_c(files_col), lambda f: F.split(f, " ")[0])))
    return F.concat_ws("-", F.lit(name), F.array_join(prefixes, "-"))


def report_to_json(report_struct) -> Column:
    """A nested report record as JSON text, non-ASCII kept."""
    return F.to_json(_c(report_struct))


def report_from_json(c) -> Column:
    """JSON text back to the declared report struct."""
    from critica.schema import REPORT
    return F.from_json(_c(c), REPORT)
