"""Operator 3 [native]: line deduplication by a log-template tree.

Lines go down a tree of fixed depth: token count, then the leading tokens
(three; two below ``LONG`` tokens, one below six), where a token with a
digit is the variable field <*>.  In a leaf, a token is a constant of its
position if two different lines at least, and a share ``CONSTANT`` of all
the leaf's different lines, have it there; every other token is variable.
So a field of many values stays variable however often each of them
occurs.  The result is the line's template if constants make up at least
``MIN_CONSTANT`` of its tokens, else the line's masked form itself is.

A template found in two documents or more is recurring: its lines are
dropped, except in the document with the smallest id that has it (its lines
stay).  Short lines agree by chance, so more documents are asked for there
(``SHORT_DOCS``): for a line of one or two tokens, which is only compared
as it stands, and for a generalised template below ``LONG`` tokens.  A line
without constant tokens is compared as it stands, too.

Scale: exact repetitions are counted first, with partial aggregates on
16-byte keys, so a line that a third of all documents share is one row per
task.  Only leaves with several different lines are opened, and each of
their lines is read once, as an array of 64-bit token hashes; a leaf's
constants are at most 1 / CONSTANT per position and come to its lines as
one row.  Texts are read again instead of being kept: the places of open
lines come to the texts as a broadcast where they are at most ``FEW``,
counted first, and by a shuffle beyond.  The numbers of the lines to drop
meet the texts by a join on the document, which moves every text once.

Defined results.  Null texts stay null.  Line ends are U+000A; a text
loses the line together with its line end.  Lines without tokens have no
template.  Lines are compared by 128 bits of hash of their masked tokens,
so white space at their ends and between tokens does not count.  Rows with
equal ids count as one document; each of them keeps its own row.  A null id
is a document of its own that comes before all others; lines that only such
rows have are compared as they stand.  Empty tables give empty results;
other columns stay as they are.  A document that loses all its lines has an
empty text and ``n_lines`` = ``n_dropped``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critica.llm.quality_rules import let
from critica.llm.store import written

#: Tokens from which a line has three leading tokens, and two documents are enough for a generalised template.
LONG = 8
#: Tokens from which digits are masked, and from which fields are generalised.
MIN_MASKED, MIN_GENERAL = 3, 4
#: Documents that make short lines and short generalised templates recurring.
SHORT_DOCS = 10
MIN_CONSTANT = 0.7
#: Share of a leaf's different lines that makes a token a constant.
CONSTANT = 1 / 3
#: Places of open lines that are broadcast instead of shuffling the texts.
FEW = 500_000

_WHITE = " \t\x0b\x0c\r"
#: A token with a digit, found from the token's first character only (linear in the line).
_VARIABLE = "(?<![^ \\t\\x0B\\f\\r])[^ \\t\\x0B\\f\\r0-9]*+[0-9][^ \\t\\x0B\\f\\r]*+"


def _spaced(line: Column) -> Column:
    """The line's tokens, one space apart.  Replacing costs far more than finding, and most lines need none of it."""
    def uneven(x: Column) -> Column:
        return reduce(lambda a, c: a | x.contains(c), "\t\x0b\x0c\r", x.contains("  "))
    return let(F.btrim(line, F.lit(_WHITE)), lambda x: F.when(
        uneven(x), F.regexp_replace(x, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(x))


def _masked(spaced: Column, n_tokens: Column) -> Column:
    """``spaced`` with <*> for tokens that have a digit, if it is long enough and a constant token is left."""
    masked = F.regexp_replace(spaced, _VARIABLE, "<*>")
    return F.when((n_tokens >= MIN_MASKED) & spaced.rlike("[0-9]"), let(masked, lambda m: F.when(
        F.replace(F.replace(m, F.lit("<*>")), F.lit(" ")) == "", spaced).otherwise(m))).otherwise(spaced)


def _n_tokens(spaced: Column) -> Column:
    return F.when(spaced == "", 0).otherwise(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "))) + 1)


def _few(df: DataFrame, lines: int) -> DataFrame:
    """``df``, to be broadcast if it stands for few lines."""
    return F.broadcast(df) if lines <= FEW else df


def _keys(*cols) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, line) of every line."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(
        F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line_no", "line"))


def _parsed(line: Column) -> Column:
    """The struct (n_tokens, masked) of a line."""
    return let(_spaced(line), lambda x: let(_n_tokens(x), lambda n: F.struct(n.alias("n_tokens"), _masked(x, n).alias("masked"))))


def _line_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, n_tokens, k1, k2, leaf): keys of the masked line and of its leaf, without any text."""
    def keys(p: Column) -> Column:
        k1, k2 = _keys(p["masked"])
        depth = F.when(p["n_tokens"] < 6, 1).when(p["n_tokens"] < LONG, 2).otherwise(3)
        lead = F.when(depth == 1, F.substring_index(p["masked"], " ", 1)).when(
            depth == 2, F.substring_index(p["masked"], " ", 2)).otherwise(F.substring_index(p["masked"], " ", 3))
        return F.struct(p["n_tokens"].alias("n_tokens"), k1.alias("k1"), k2.alias("k2"),
                        F.xxhash64(p["n_tokens"], lead).alias("leaf"))
    rows = _lines(docs, id_col, text_col).select("doc", "line_no", let(_parsed(F.col("line")), keys).alias("_k"))
    return written(rows.select("doc", "line_no", "_k.*").where(F.col("n_tokens") > 0), "line-keys")


def _distinct_lines(keys: DataFrame) -> DataFrame:
    """(k1, k2, n_tokens, leaf, first, last, nulls, docs, place) of every different line.

    ``docs`` counts documents where more than two can be asked for; ``place``
    is where the line's text stands, null if only rows without id have it.
    """
    place = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "line_no"))).alias("place")
    no_id = F.max(F.col("doc").isNull().cast("int")).alias("nulls")
    long = keys.where(F.col("n_tokens") >= LONG).groupBy("k1", "k2").agg(
        F.first("n_tokens").alias("n_tokens"), F.first("leaf").alias("leaf"), F.min("doc").alias("first"), F.max("doc").alias("last"),
        no_id, F.lit(2).cast("long").alias("docs"), place)
    short = keys.where(F.col("n_tokens") < LONG).groupBy("k1", "k2", "doc").agg(
        F.first("n_tokens").alias("n_tokens"), F.first("leaf").alias("leaf"), F.min("line_no").alias("line_no")) \
        .groupBy("k1", "k2").agg(
        F.first("n_tokens").alias("n_tokens"), F.first("leaf").alias("leaf"), F.min("doc").alias("first"), F.max("doc").alias("last"),
        no_id, F.count("*").alias("docs"), place)
    return written(long.unionByName(short), "distinct-lines")


def _several(first: Column, last: Column, nulls: Column) -> Column:
    """Whether two different documents are among those from ``first`` to ``last`` and the ones without id."""
    return F.coalesce(first < last, F.lit(False)) | ((nulls > 0) & first.isNotNull())


def _templates(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, t1, t2): template key of each line that its leaf's constants generalise."""
    wide = distinct.where((F.col("n_tokens") >= MIN_GENERAL) & F.col("place").isNotNull())
    # Leaves on keys alone: most hold one line, or lines of one document, and need no tokens.
    leaves = wide.groupBy("leaf").agg(F.count("*").alias("lines"), F.min("first").alias("_first"), F.max("last").alias("_last")) \
        .where((F.col("lines") > 1) & (F.col("_first") < F.col("_last"))).select("leaf", "lines")
    open_lines = written(wide.join(leaves, "leaf").select(
        "k1", "k2", "leaf", "lines", F.col("place.doc").alias("doc"), F.col("place.line_no").alias("line_no")), "open-lines")

    def pairs(p: Column) -> Column:
        k1, k2 = _keys(p["masked"])
        hashes = F.transform(F.split(p["masked"], " "), lambda t, i: F.when(t != "<*>", F.xxhash64(i, t)))
        return F.struct(k1.alias("l1"), k2.alias("l2"), p["n_tokens"].alias("n"), F.array_compact(hashes).alias("tokens"))

    # Only documents with open lines are split again, and only those lines taken out.
    wanted = open_lines.groupBy("doc").agg(F.collect_list(F.struct("line_no", "k1", "k2", "leaf", "lines")).alias("_open"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("_text")).join(
        _few(wanted, open_lines.count()), "doc")

    def taken(lines: Column) -> Column:
        return F.transform("_open", lambda o: F.struct(o["k1"].alias("k1"), o["k2"].alias("k2"), o["leaf"].alias("leaf"),
                                                       o["lines"].alias("lines"), F.get(lines, o["line_no"]).alias("line")))

    found = texts.select(F.explode(let(F.split("_text", "\n", -1), taken)).alias("_o")).select("_o.*").where(F.col("line").isNotNull())
    # Rows of equal id can have other lines there.
    found = found.select("k1", "k2", "leaf", "lines", let(_parsed(F.col("line")), pairs).alias("_p")).where(
        (F.col("_p.l1") == F.col("k1")) & (F.col("_p.l2") == F.col("k2")))
    tokens = written(found.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in ("leaf", "lines", "_p"))).select(
        "k1", "k2", "leaf", "lines", "_p.n", "_p.tokens"), "line-tokens")
    constants = tokens.select("leaf", "lines", F.explode("tokens").alias("h")).groupBy("leaf", "h").agg(
        F.count("*").alias("_c"), F.first("lines").alias("lines")) \
        .where((F.col("_c") > 1) & (F.col("_c") >= CONSTANT * F.col("lines"))).groupBy("leaf").agg(F.collect_list("h").alias("constants"))
    filled = tokens.join(constants, "leaf").select(
        "k1", "k2", "leaf", "n", F.array_intersect("tokens", "constants").alias("_template")) \
        .where(F.size("_template") >= MIN_CONSTANT * F.col("n"))
    t1, t2 = _keys("leaf", "_template")
    return filled.select("k1", "k2", t1.alias("t1"), t2.alias("t2"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line_no): the lines to drop."""
    keys = _line_keys(docs, id_col, text_col)
    distinct = _distinct_lines(keys)
    several = _several(F.col("first"), F.col("last"), F.col("nulls"))
    keeper = F.when(F.col("nulls") == 0, F.col("first"))
    own = written(distinct.drop("place").join(_templates(docs, distinct, id_col, text_col), ["k1", "k2"], "left").select(
        "k1", "k2", "t1", "t2", "n_tokens", "first", "last", "nulls", "docs",
        (several & (F.col("docs") >= F.when(F.col("n_tokens") < MIN_MASKED, SHORT_DOCS).otherwise(2))).alias("exact"),
        keeper.alias("_own")), "line-templates")
    general = own.where(F.col("t1").isNotNull())
    recurring = general.groupBy("t1", "t2").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("nulls").alias("nulls"),
        F.sum("docs").alias("docs"), F.first("n_tokens").alias("n_tokens")) \
        .where(several & (F.col("docs") >= F.when(F.col("n_tokens") < LONG, SHORT_DOCS).otherwise(2))) \
        .select("t1", "t2", keeper.alias("_keeper"), F.lit(True).alias("_recurs"))
    # A line of a recurring template goes with it; any other one by its own recurrence.
    general = general.join(recurring, ["t1", "t2"], "left").where(F.col("_recurs") | F.col("exact")).select(
        "k1", "k2", F.when(F.col("_recurs"), F.col("_keeper")).otherwise(F.col("_own")).alias("_keeper"))
    marked = own.where(F.col("t1").isNull() & F.col("exact")).select("k1", "k2", F.col("_own").alias("_keeper")).unionByName(general)
    return keys.select("doc", "line_no", "k1", "k2").join(marked, ["k1", "k2"]) \
        .where(~F.col("doc").eqNullSafe(F.col("_keeper"))).select("doc", "line_no")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the recurring lines cut out of their texts, and n_lines and n_dropped."""
    dropped = written(recurring_lines(docs, id_col, text_col).groupBy("doc").agg(
        F.collect_set("line_no").alias("_dropped")).withColumnRenamed("doc", "_doc"), "dropped-lines")
    gone = F.coalesce(F.col("_dropped"), F.array().cast("array<int>"))

    def without(lines):
        # Set difference is linear in the number of lines.
        kept = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.col(text_col).cast("string")
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).cast("long")
    # The same plan at every size: the list of a hot source's lines may be long.
    return docs.join(dropped.hint("merge"), F.col(id_col).eqNullSafe(F.col("_doc")), "left").drop("_doc").withColumns({
        text_col: F.when(F.size(gone) == 0, text).otherwise(let(F.split(text, "\n", -1), without)),
        "n_lines": n_lines, "n_dropped": F.size(gone).cast("long")}).drop("_dropped")
