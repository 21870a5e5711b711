"""Operator 8 [native]: quality rules from a threshold table.

The table (RULES) names a ratio and the range it must lie in.  It is
compiled into one projection over the text column: word, symbol,
stop-word and line measures, then one boolean per rule, then the names of
the rules a document breaks.  There is no shuffle, no user function and no
Python on the executors; each document is judged by itself in memory that
its own length bounds.

Words are runs of characters other than U+0020 and U+0009-U+000D.

Repeated words: the 64-bit hashes of all three-word windows of a text are
compared (two different windows of one text agree by chance with a
probability of 2^-64 per pair).  Texts without an equal pair are done;
otherwise the windows are sorted by hash and the words they cover counted.

Defined results.  Null and empty texts and texts of white space only have
no words, fail the base rules and are not kept; their ratios are null and
break no further rule.  Repeated rows are judged row by row.  An empty
table gives an empty result.  Columns of the input that have the name of
a measure are replaced by it in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, Spanish and German, as written within a sentence.
STOP_WORDS = (
    "the of and to in is that it for with as on by this be at are or an not from was "
    "de la le les et des un une en que qui du pour par sur dans est il au ce pas "
    "el los las del se por con y lo su al es "
    "der die das und zu den im mit ein eine ist von auf sich nicht dem des für").split()
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: (rule, measure, least, most): a document is rejected if the measure lies outside; None: no bound.
RULES = (
    ("word_length", "mean_word_chars", 3.0, 10.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("letters", "share_words_with_letter", 0.8, None),
    ("stop_words", "share_stop_words", 0.02, None),
    ("duplicate_lines", "share_duplicate_lines", None, 0.5),
    ("bullet_lines", "share_bullet_lines", None, 0.9),
    ("ellipsis_lines", "share_ellipsis_lines", None, 0.3),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    The one-element array keeps the optimizer from writing the value's
    expression into every place, and every array element, that uses it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(positions: Column) -> Column:
    """Words covered by three-word windows at ascending positions."""
    return F.aggregate(
        positions, F.struct(F.lit(-3).alias("before"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("before"), (acc["n"] + F.least(F.lit(3), p - acc["before"])).alias("n")),
        lambda acc: acc["n"])


def _equal_windows(windows: Column) -> Column:
    """Ascending positions of the windows, sorted by hash, that have the hash of a neighbour."""
    last = F.size(windows) - 1
    equal = F.filter(windows, lambda w, i: (
        ((i > 0) & (w["h"] == F.get(windows, i - 1)["h"])) | ((i < last) & (w["h"] == F.get(windows, i + 1)["h"]))))
    return F.sort_array(F.transform(equal, lambda w: w["p"]))


def _repeated(words: Column) -> Column:
    """Words in three-word windows that a text has twice or more."""
    def of_hashes(hashes: Column) -> Column:
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(windows, lambda w: _covered(_equal_windows(w))))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole)


def measured(text: Column) -> Column:
    """All measures of a text as one struct."""
    def of_text(plain: Column) -> Column:
        trimmed = F.btrim(plain, F.lit(WHITE_SPACE))
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
            F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
        lines = F.filter(F.split(plain, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE_SPACE)) != "")
        return let(F.struct(words.alias("words"), lines.alias("lines")), lambda p: of_parts(plain, p["words"], p["lines"]))

    def of_parts(plain: Column, words: Column, lines: Column) -> Column:
        n, n_lines = F.size(words), F.size(lines)
        chars = F.length(F.translate(plain, WHITE_SPACE, "")).cast("long")
        symbols = (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long")
        repeats = (n_lines - F.size(F.array_distinct(lines))).cast("long")
        return F.struct(
            n.cast("long").alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"),
            repeats.alias("n_dup_lines"), _repeated(words).alias("n_repeat_words"),
            _share(chars, n).alias("mean_word_chars"), _share(symbols, n).alias("symbols_per_word"),
            _share(F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))), n).alias("share_words_with_letter"),
            _share(F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))), n).alias("share_stop_words"),
            _share(repeats, n_lines).alias("share_duplicate_lines"),
            _share(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(WHITE_SPACE)).rlike("^[-*•‣▪◦]"))), n_lines)
            .alias("share_bullet_lines"),
            _share(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(WHITE_SPACE)).rlike("(\\.\\.\\.|…)$"))), n_lines)
            .alias("share_ellipsis_lines"))

    return let(F.coalesce(text.cast("string"), F.lit("")), of_text)


def compiled(measure_of, rules=RULES) -> Column:
    """The names of the rules that measures break, as one array expression.

    ``measure_of``: the column of a measure's name.
    """
    broken = []
    for name, measure, least, most in rules:
        outside = F.lit(False)
        if least is not None:
            outside = outside | (measure_of(measure) < F.lit(float(least)))
        if most is not None:
            outside = outside | (measure_of(measure) > F.lit(float(most)))
        broken.append(F.when(outside, F.lit(name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def verdict(text: Column, rules=RULES, min_words: int = MIN_WORDS,
            max_repeated_percent: int = MAX_REPEATED_PERCENT) -> Column:
    """The struct (measures, base_failed, broken_rules, kept) of a text."""
    def of_measures(m: Column) -> Column:
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeated_percent * m["n_words"])
        return let(compiled(lambda name: m[name], rules), lambda broken: F.struct(
            m.alias("measures"), failed.alias("base_failed"), broken.alias("broken_rules"),
            (~failed & (F.size(broken) == 0)).alias("kept")))
    return let(measured(text), of_measures)


MEASURES = (*BASE, "mean_word_chars", "symbols_per_word", "share_words_with_letter", "share_stop_words",
            "share_duplicate_lines", "share_bullet_lines", "share_ellipsis_lines")


def judge(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the measures, base_failed, broken_rules and kept."""
    out = docs.withColumn("_verdict", verdict(F.col(text_col), **options))
    return out.withColumns({m: F.col("_verdict")["measures"][m] for m in MEASURES} | {
        c: F.col("_verdict")[c] for c in ("base_failed", "broken_rules", "kept")}).drop("_verdict")


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    return docs.where(verdict(F.col(text_col), **options)["kept"])
