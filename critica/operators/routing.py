"""Projections, filters and routing of reviews into categories (§2.B, G5).

All operators are narrow (no shuffle) and stay in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.functions import text as TX
from critica.functions.language import detect_language

ROUTE_TEXT = {"is_fea": "feature request", "is_pro": "problem report", "is_irr": "irrelevant"}


def project(df: DataFrame, cols) -> DataFrame:
    """Column subset (B1)."""
    return df.select(*cols)


def filter_language(df: DataFrame, lang: str | None) -> DataFrame:
    """``en``/``fr`` keep that language; anything else (``bi``) keeps all (B2)."""
    if lang in ("en", "fr"):
        return df.where(F.col("ori_lang") == lang)
    return df


def filter_label(df: DataFrame, label: str) -> DataFrame:
    """Rows carrying a label."""
    return df.where(F.col(label) == 1)


def route_by_text(df: DataFrame, answer_col: str = "result") -> DataFrame:
    """Three non-exclusive boolean routes from a free-text answer.

    Case-insensitive substring; a null answer routes nowhere.
    """
    return df.select("*", *[TX.matches_answer_label(answer_col, t).alias(k)
                            for k, t in ROUTE_TEXT.items()])


def route_long(df: DataFrame, answer_col: str = "result", keep=("review_id",)) -> DataFrame:
    """One row per (review, category) it was routed to (G5).  Unrouted reviews vanish."""
    cats = F.array_compact(F.array(*[
        F.when(TX.matches_answer_label(answer_col, t), F.lit(k[3:]))
        for k, t in ROUTE_TEXT.items()]))
    return df.select(*keep, F.explode(cats).alias("category"))


def parse_structured_answer(df: DataFrame, answer_col: str = "result") -> DataFrame:
    """0/1 labels from the ``Label: value`` answer form."""
    r = F.col(answer_col)
    return df.select(
        "*",
        F.coalesce(r.rlike(TX.IRRELEVANT_ANSWER), F.lit(False)).cast("int").alias("pred_irrelevant"),
        F.coalesce(r.rlike(TX.FEATURE_ANSWER), F.lit(False)).cast("int").alias("pred_feature_request"),
        F.coalesce(r.rlike(TX.PROBLEM_ANSWER), F.lit(False)).cast("int").alias("pred_problem_report"),
    )


def threshold_labels(df: DataFrame, cols, t: float = 0.5, prefix: str = "pred_") -> DataFrame:
    """score > t → 1 else 0, strict."""
    return df.select("*", *[F.when(F.col(c) > t, 1).otherwise(0).cast("int").alias(prefix + c)
                            for c in cols])


def cluster_members(df: DataFrame, i: int) -> DataFrame:
    """Rows of one cluster (B7).  Pipelines use a grouped form instead of a loop."""
    return df.where(F.col("clusters") == i)


def keep_large_groups(df: DataFrame, key, n: int = 5) -> DataFrame:
    """Rows whose group (``key``) has at least ``n`` members.

    Counts are computed by a partial/final aggregate and joined back (a
    semi join); a window over a hot group would put the whole group in one
    task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    big = df.groupBy(*keys).count().where(F.col("count") >= n).drop("count")
    return df.join(big, keys, "left_semi")


def split_noise(df: DataFrame) -> DataFrame:
    """``is_noise`` flag for the ``-1`` cluster."""
    return df.withColumn("is_noise", F.col("clusters") == -1)


def drop_null_key(df: DataFrame, key: str) -> DataFrame:
    """Ignore rows with a null group key."""
    return df.na.drop(subset=[key])


def coerce_text(df: DataFrame, col: str = "data") -> DataFrame:
    """Missing text becomes '' and is flagged."""
    return df.withColumn(f"{col}_missing", F.col(col).isNull()).withColumn(col, TX.coerce_text(col))


def language_name(df: DataFrame, text_col: str = "data") -> DataFrame:
    """``lang_name``: English/French from ``ori_lang``, else detected, fallback English."""
    detected = detect_language(F.col(text_col))
    names = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
    det_name = F.lit("English")
    for code, name in reversed(list(names.items())):
        det_name = F.when(detected == code, F.lit(name)).otherwise(det_name)
    return df.withColumn("lang_name", F.coalesce(TX.language_name("ori_lang"), det_name))


def ensure_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add missing optional columns as typed nulls (or given defaults)."""
    defaults = defaults or {"app": "app"}
    for f in schema.fields:
        if f.name not in df.columns:
            v = defaults.get(f.name)
            df = df.withColumn(f.name, F.lit(v).cast(f.dataType))
    return df


def min_words(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Keep rows whose text has at least ``n`` whitespace-separated words."""
    return df.where(TX.word_count(col) >= n)
