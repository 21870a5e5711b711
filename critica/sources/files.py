"""File sources and sinks (§2.A).  Declared schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critica.operators.ranking import carry_heading, distributed_rank
from critica.schema import CLUSTERED_CSV, EMBEDDED, REPORT, RESPONSE_CSV, REVIEW_CSV


def _csv(spark: SparkSession, schema):
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("encoding", "UTF-8"))


def with_review_id(df: DataFrame) -> DataFrame:
    """Stable ``review_id`` for keyless CSV rows.

    ``review_key`` = sha2 of (app, language, text); identical rows are told
    apart by an occurrence number (ordered by source file), and the id is
    the first 60 bits of the hash of key and occurrence.
    """
    key = F.sha2(F.concat_ws("\u0001", F.coalesce("app", F.lit("")), F.coalesce("ori_lang", F.lit("")),
                             F.coalesce("data", F.lit(""))), 256)
    src = F.col("_metadata.file_path") if "_source" not in df.columns else F.col("_source")
    d = df.withColumn("review_key", key).withColumn("_src", src)
    cols = [c for c in df.columns]
    d = distributed_rank(d, ["review_key"], ["_src", *[c for c in cols if c not in ("review_key",)]], "occurrence")
    rid = F.conv(F.substring(F.sha2(F.concat_ws("#", "review_key", F.col("occurrence").cast("string")), 256),
                             1, 15), 16, 10).cast("bigint")
    return d.withColumn("review_id", rid).drop("_src")


def read_reviews(spark: SparkSession, paths, schema=REVIEW_CSV, with_ids: bool = True) -> DataFrame:
    """Labelled review CSV: header, quoted commas, doubled quotes, UTF-8 (A1)."""
    df = _csv(spark, schema).csv(paths)
    df = df.withColumn("_source", F.col("_metadata.file_path"))
    return with_review_id(df).drop("_source") if with_ids else df.drop("_source")


def _path_part(idx: int):
    """Decoded path component counted from the end (-1 = file name)."""
    return F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), idx)


def read_corpus(spark: SparkSession, root: str, schema=REVIEW_CSV) -> DataFrame:
    """``root/<app>/<category>.csv``: app from the folder, category from the file stem (A2)."""
    df = _csv(spark, schema).csv(f"{root}/*/*.csv")
    return df.withColumn("app_folder", _path_part(-2)).withColumn(
        "category", F.regexp_replace(_path_part(-1), r"\.csv$", ""))


def read_named(spark: SparkSession, folder: str, names, schema=REVIEW_CSV) -> DataFrame:
    """Configured list ``<folder>/<name>.csv`` in one scan; the name is kept as ``dataset`` (A3, G1)."""
    df = _csv(spark, schema).csv([f"{folder}/{n}.csv" for n in names])
    return df.withColumn("dataset", F.regexp_replace(_path_part(-1), r"\.csv$", ""))


def read_embedded(spark: SparkSession, path: str) -> DataFrame:
    """JSON records with vector columns (A4)."""
    return spark.read.schema(EMBEDDED).option("multiLine", True).json(path)


def read_clustered(spark: SparkSession, root: str) -> DataFrame:
    """``root/<run>/<app>/<category>.csv`` cluster outputs; non-CSV files are skipped (A5)."""
    df = _csv(spark, CLUSTERED_CSV).csv(f"{root}/*/*/*.csv")
    return (df.withColumn("run", _path_part(-3)).withColumn("app_folder", _path_part(-2))
            .withColumn("category", F.regexp_replace(_path_part(-1), r"\.csv$", "")))


def read_responses(spark: SparkSession, path) -> DataFrame:
    """Labelled rows with a multi-line free-text ``result``."""
    return _csv(spark, RESPONSE_CSV).csv(path)


# A classification-report row (name, precision, recall, f1, support).
REPORT_ROW = r"^\s*([A-Za-z_][\w ]*?)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+)\s*$"
LANG_LINE = r"Original language:\s*(\S+)"


def read_run_logs(spark: SparkSession, root: str, prefixes) -> DataFrame:
    """Metric rows of run logs ``root/<run>/log.log`` whose run name starts with a prefix.

    Rows are found by their shape, not by line number; each row carries the
    language of the block it belongs to.
    """
    raw = spark.read.option("wholetext", True).text(f"{root}/*/log.log").withColumn(
        "run", _path_part(-2))
    cond = None
    for p in prefixes:
        c = F.col("run").startswith(p)
        cond = c if cond is None else cond | c
    raw = raw.where(cond) if cond is not None else raw
    lines = raw.select("run", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    lines = lines.withColumn("_lang", F.when(F.col("line").rlike(LANG_LINE),
                                             F.regexp_extract("line", LANG_LINE, 1)))
    lines = carry_heading(lines, "run", "pos", "_lang", "ori_lang")
    rows = lines.where(F.col("line").rlike(REPORT_ROW))
    return rows.select(
        "run", "ori_lang", F.trim(F.regexp_extract("line", REPORT_ROW, 1)).alias("row_name"),
        F.regexp_extract("line", REPORT_ROW, 2).cast("double").alias("precision"),
        F.regexp_extract("line", REPORT_ROW, 3).cast("double").alias("recall"),
        F.regexp_extract("line", REPORT_ROW, 4).cast("double").alias("f1"),
        F.regexp_extract("line", REPORT_ROW, 5).cast("bigint").alias("support"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report JSON records."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


# --------------------------------------------------------------------------
# Sinks

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "overwrite"):
    """Splits, predictions, clusters, summaries; no index column (A10)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True).option("quote", '"').option("escape", '"')
    w.format(fmt).save(path)


def write_embedded(df: DataFrame, path: str, mode: str = "overwrite"):
    """Vector records as JSON lines."""
    df.write.mode(mode).json(path)


def write_report(reports: DataFrame, path: str, mode: str = "overwrite"):
    """One JSON record per app under ``app_slug=<slug>/`` (A12); text is written unescaped UTF-8."""
    from critica.functions.text import app_slug
    reports.withColumn("app_slug", app_slug("app")).write.mode(mode).partitionBy("app_slug").json(path)


def write_sheet(lines: DataFrame, path: str, mode: str = "overwrite"):
    """Rating-sheet lines as text, one folder per sheet, lines in position order."""
    (lines.repartition("file").sortWithinPartitions("file", "pos")
     .select("file", "line").write.mode(mode).partitionBy("file").text(path))
