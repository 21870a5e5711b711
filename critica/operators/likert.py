"""Rating sheets for summaries: render, parse, average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.functions import text as TX
from critica.operators.metrics import DIMENSIONS
from critica.operators.ranking import distributed_ffill

# The rating grid of one summary (header, rule, four dimension rows).
GRID_HEADER = "|                 | Very unsatisfied | Unsatisfied | Neutral | Satisfied | Very satisfied |"
GRID_RULE = "| --------------- | ---------------- | ----------- | ------- | --------- | -------------- |"
DIM_LABELS = {"Relevance": "| **Relevance**   |", "Consistency": "| **Consistency** |",
              "Fluency": "| **Fluency**     |", "Coherence": "| **Coherence**   |"}
EMPTY_CELLS = ["                  ", "             ", "         ", "           ", "                "]
HEADING_RE = r"^# (.+)\.(en|fr|bi)\s*$"
DIM_RE = r"^\| +\*\*(Relevance|Consistency|Fluency|Coherence)\*\* +\|"


def grid_row(dimension: str, rating_col) -> "F.Column":
    """One dimension row with an ``X`` in column ``rating`` (1..5), none when 0/null."""
    cells = []
    for i, blank in enumerate(EMPTY_CELLS, start=1):
        cells.append(F.when(rating_col == i, F.lit(" X" + blank[2:])).otherwise(F.lit(blank)))
    parts = [F.lit(DIM_LABELS[dimension])]
    for c in cells:
        parts += [c, F.lit("|")]
    return F.concat(*parts)


def likert_sheet(items: DataFrame, rating_cols: dict | None = None) -> DataFrame:
    """Sheet lines for summaries.

    ``items``: app, lang, category, item, document, summary and optional
    rating columns (pre-filled marks, for round-trip tests).  Output:
    (file, pos, line) with ``file = app.lang``; ``pos`` orders the lines of
    a file: (category, item, line number) packed into one sortable key.
    """
    rating_cols = rating_cols or {}
    reviews = F.transform(TX.split_document("document"), lambda r: F.concat(F.lit("* "), r))
    grid = [F.lit(""), F.lit(GRID_HEADER), F.lit(GRID_RULE)]
    for d in DIMENSIONS:
        grid.append(grid_row(d, F.col(rating_cols[d]) if d in rating_cols else F.lit(0)))
    body = F.concat(
        F.array(F.concat(F.lit("### "), F.col("item").cast("string")), F.lit("**User reviews:**")),
        reviews,
        F.array(F.lit(""), F.lit("**Summary:**"), F.coalesce(F.col("summary"), F.lit(""))),
        F.array(*grid), F.array(F.lit("")))
    lines = items.select(F.concat_ws(".", "app", "lang").alias("file"), "category", "item",
                         F.posexplode(body).alias("ln", "line"))
    heads = items.select(F.concat_ws(".", "app", "lang").alias("file"), "app", "lang").distinct().select(
        "file", F.lit("").alias("category"), F.lit(-2).cast("long").alias("item"), F.lit(0).alias("ln"),
        F.concat(F.lit("# "), F.col("file")).alias("line"))
    cats = items.select(F.concat_ws(".", "app", "lang").alias("file"), "category").distinct().select(
        "file", "category", F.lit(-1).cast("long").alias("item"), F.lit(0).alias("ln"),
        F.concat(F.lit("## "), F.col("category")).alias("line"))
    allrows = lines.select("file", "category", F.col("item").cast("long"), "ln", "line").unionByName(
        heads).unionByName(cats)
    pos = F.struct("category", "item", "ln")
    return allrows.select("file", pos.alias("pos"), "line")


def parse_likert(lines: DataFrame, file_col: str = "file", pos_col: str = "pos") -> DataFrame:
    """Dimension rows of a filled sheet with the language of their heading.

    Output: file, lang, dimension, rating (0 when unmarked).
    """
    head = F.when(F.col("line").rlike(HEADING_RE), F.regexp_extract("line", HEADING_RE, 2))
    tagged = lines.withColumn("_head", head)
    filled = distributed_ffill(tagged, [file_col], [pos_col], "_head", "lang")
    dims = filled.where(F.col("line").rlike(DIM_RE))
    return dims.select(file_col, "lang", F.regexp_extract("line", DIM_RE, 1).alias("dimension"),
                       TX.likert_mark("line").alias("rating"))


def read_sheet_lines(spark, path: str) -> DataFrame:
    """Sheet files → (file, pos, line); one whole-text row per file, split to lines."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return raw.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
