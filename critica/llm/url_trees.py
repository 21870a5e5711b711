"""Operator 4 [native]: URL filter rules, and gradient-boosted trees for the URLs that no rule fits.

Rules are written ``host/path-prefix``.  A rule fits its host and all
subdomains if the URL's path starts with the rule's; the longest rule
wins.  The rule list is a parameter and compiled into one CASE expression.

The URLs that a rule fits are the labelled ones.  They give block rates of
the host's suffixes (one and two labels), alone and with the path's first
segment, counted over all of them.  A bounded sample (``SAMPLE`` different
URLs, those with the smallest hashes, so the same ones each time) trains
Spark ML's gradient-boosted trees on lexical features: lengths, depth,
digit ratio, character entropy, parameter counts, marks, and those rates.
A sampled URL takes its rates from the half of the labelled URLs, by hash,
that it is not in, so its own label is not among its features.  All URLs
are then scored in the JVM.

Features are column expressions; nothing runs in Python.  The table itself
is read four times and not shuffled while the suffix statistics are at most
``FEW`` rows, counted first; beyond that they are joined by a shuffle.

Defined results.  A null URL, and one without ``://``, has an empty host
and path; no rule fits it and the trees judge its (zero) features.  Where
no sample exists, or one with one label only, the default verdict is that
label's, or allow.  Repeated rows are judged row by row.  An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critica.llm.quality_rules import let
from critica.llm.store import written

#: The rules of the query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
#: Different labelled URLs that train the trees (the suffix statistics are of all rows).
SAMPLE = 20_000
#: Rows of suffix statistics that are broadcast instead of moving the URLs, counted first.
FEW = 200_000
TREES, DEPTH, BINS, SEED = 10, 4, 32, 7
#: Weight of the overall rate in a suffix's statistic, in URLs.
PRIOR = 10.0
FEATURES = ("url_chars", "host_chars", "path_chars", "query_chars", "host_labels", "path_depth", "digit_share", "entropy",
            "n_params", "n_hyphens", "n_dots", "longest_segment", "last_label_chars", "has_fragment", "is_https",
            *(f"suffix{k}_{what}" for k in (1, 2, 3, 4) for what in ("rate", "seen")))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted({r for r, _ in rules}, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    return reduce(lambda out, r: F.when(rule == r[0], F.lit(r[1])).otherwise(out), rules, F.lit(None).cast("string"))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - let(
            (n - F.length(F.replace(text, c))) / n, lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0))))


def _features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    def count(chars: str) -> Column:
        return (F.length(url) - F.length(F.translate(url, chars, ""))).cast("double")
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    labels = F.split(host, "\\.")
    segments = F.split(path, "/")
    long = F.array_max(F.transform(segments, lambda s: F.length(s)))
    return {
        "url_chars": F.length(url), "host_chars": F.length(host), "path_chars": F.length(path),
        "query_chars": F.length(query), "host_labels": F.size(labels),
        "path_depth": F.size(F.filter(segments, lambda s: s != "")),
        "digit_share": count("0123456789") / F.greatest(F.length(url), F.lit(1)), "entropy": _entropy(url),
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "n_hyphens": count("-_"), "n_dots": count("."), "longest_segment": F.coalesce(long, F.lit(0)),
        "last_label_chars": F.length(F.get(labels, F.size(labels) - 1)),
        "has_fragment": url.contains("#").cast("double"), "is_https": url.startswith("https").cast("double"),
    }


def described(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and the lexical features."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    out = out.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    out = out.withColumns({k: v.cast("double") for k, v in _features(url, F.col("host"), F.col("path")).items()})
    segment = F.regexp_extract("path", "^/([^/]*)/", 1)
    return out.withColumns({"_suffix1": F.substring_index("host", ".", -1), "_suffix2": F.substring_index("host", ".", -2),
                            "_suffix3": F.concat(F.substring_index("host", ".", -1), F.lit("/"), segment), "_suffix4": segment})


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(_level, _suffix, b0, n0, b1, n1): blocked and all URLs of each suffix over all labelled rows, by hash half of the URL."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), F.col(f"_suffix{k}").alias("_suffix")) for k in (1, 2, 3, 4)]))
    rows = labelled.select("_half", "blocked", levels.alias("_s")).select("_half", "blocked", "_s._level", "_s._suffix")
    first = F.col("_half") == 0
    return written(rows.groupBy("_level", "_suffix").agg(
        F.sum(F.when(first, F.col("blocked")).otherwise(0)).alias("b0"), F.count(F.when(first, 1)).alias("n0"),
        F.sum(F.when(first, 0).otherwise(F.col("blocked"))).alias("b1"), F.count(F.when(~first, 1)).alias("n1")), "url-suffixes")


def _with_suffix_rates(df: DataFrame, counts: DataFrame, overall: float, apart: bool) -> DataFrame:
    """``df`` with its suffixes' rates; ``apart``: those of the other half only, as no row may tell its own label."""
    few = counts.limit(FEW + 1).count() <= FEW
    own = F.col("_half") == 0
    for k in ("1", "2", "3", "4"):
        side = counts.where(F.col("_level") == int(k)).select(F.col("_suffix").alias(f"_suffix{k}"), "b0", "n0", "b1", "n1")
        df = df.join(F.broadcast(side) if few else side, f"_suffix{k}", "left")
        b, n = (F.when(own, F.col(f"{c}1")).otherwise(F.col(f"{c}0")) if apart else F.col(f"{c}0") + F.col(f"{c}1") for c in "bn")
        seen = F.coalesce(n, F.lit(0)).cast("double")
        df = df.withColumns({f"suffix{k}_rate": (F.coalesce(b, F.lit(0)) + PRIOR * overall) / (seen + PRIOR),
                             f"suffix{k}_seen": F.log1p(seen)}).drop("b0", "n0", "b1", "n1")
    return df


def train(labelled: DataFrame, sample: int = SAMPLE):
    """(model, suffix counts, overall rate) from rows of ``described`` with a column ``blocked`` (0 or 1).

    Counts and the rate are of all rows; the trees are fitted on at most
    ``sample`` different URLs, those with the smallest hashes.  The model
    is None if they have not both labels.
    """
    order = F.xxhash64("host", "path", "url_chars")
    rows = labelled.withColumn("_order", order).withColumn("_half", F.pmod(F.xxhash64("_order"), F.lit(2)))
    n, blocked = rows.agg(F.count("*"), F.sum("blocked")).first()
    overall = float(blocked or 0) / n if n else 0.0
    counts = suffix_counts(rows)
    model = None
    least = rows.select("_order").distinct().orderBy("_order").limit(sample).agg(F.max("_order")).first()[0]
    if least is not None:
        few = written(rows.where(F.col("_order") <= least).dropDuplicates(["_order"]), "url-sample")
        both = few.agg(F.min("blocked"), F.max("blocked")).first()
        if both[0] == 0 and both[1] == 1:
            data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
                _with_suffix_rates(few, counts, overall, True)).select("features", F.col("blocked").cast("double").alias("label"))
            model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED, stepSize=0.3).fit(data)
    return model, counts, overall


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """``pages`` with host, path, rule, block_probability and verdict."""
    names = {c: f"_in_{i}" for i, c in enumerate(pages.columns)}
    inner = pages.select(*(F.col(f"`{c}`").alias(v) for c, v in names.items()))
    rows = described(inner, names[url_col], rules)
    labelled = rows.where(F.col("rule").isNotNull()).withColumn(
        "blocked", (rule_verdict(F.col("rule"), rules) == "block").cast("int")).drop(*names.values())
    model, counts, overall = train(labelled, sample)
    if model is None:
        rows = rows.withColumn("block_probability", F.lit(overall))
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
            _with_suffix_rates(rows.withColumn("_half", F.lit(0)), counts, overall, False))
        rows = model.transform(rows).withColumn("block_probability", F.get(vector_to_array("probability"), F.lit(1)))
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    kept = [F.col(v).alias(c) for c, v in names.items() if c not in ("host", "path", "rule", "verdict", "block_probability")]
    return rows.select(*kept, "host", "path", "rule", "block_probability",
                       F.coalesce(rule_verdict(F.col("rule"), rules), own).alias("verdict"))
