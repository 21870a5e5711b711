"""Operator 1: best-fit packing by the sum-of-squares rule.

Documents become token pieces of at most ``capacity`` tokens; pieces are
packed into sequences of ``capacity`` tokens.  A piece goes to the open
sequence (bin) for which the sum over all residual gaps g of N(g)^2 is
smallest afterwards, where N(g) is the number of open bins with gap g.  A
full bin has gap 0 and leaves the sum.  Only if no open bin has room is a
new one opened.  Pieces come in descending length (offline order), which
measured fewer sequences than random order.

Scale: whole pieces (length = capacity) are sequences by themselves and
never move.  The others are dealt by a hash of their key over groups of
about ``items_per_task`` pieces, whatever source or length they have; one
group is one bounded task.  Pieces of bins that stay emptier than
``slack`` are counted and dealt again over as many groups as their number
needs, down to one group.  A round that finishes fewer than ``GAIN`` of its
pieces ends this: lengths that do not fill sequences (no two fit together)
do so in no other group either, so its bins stay as they are.  Rows of
equal keys share a hash; a group that they overfill is dealt by row, so
no group holds more than about three times ``items_per_task`` pieces.

Defined results.  Null text counts as empty; a document without tokens
has only its end id.  Repeated documents and repeated ids are packed row
by row.  Input columns other than id and text are not carried.  A piece
longer than the capacity gets a sequence of its own; a null or
non-positive size takes no place (sequence_id and offset null).  An empty
table gives an empty result with the same columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.llm import chunks as C
from critica.llm.store import written

#: Pieces that one packing task handles.
ITEMS_PER_TASK = 32_768
#: A bin emptier than this share is packed again with the leftovers of other tasks.
SLACK = 1 / 64
#: Share of its pieces that a round must finish for another one to follow.
GAIN = 1 / 4


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(id, piece, start, length, ids): every document's ids plus ``end_id``, cut into pieces.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.
    A document longer than ``capacity`` is cut so that all pieces but the
    first are full.
    """
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, src.schema[0].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def cut(batches):
        for batch in batches:
            for part in C.slices(batch, "_text"):
                ids, offsets = C.encode_ids(part.column(1), tokenizer_path, end_id)
                lens = np.diff(offsets)
                n_pieces = -(-lens // capacity)
                row = np.repeat(np.arange(len(lens)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                first = lens - (n_pieces - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                at = offsets[row] + start
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), C.binary_column(ids, np.append(at, len(ids)))],
                    names=[id_col, "piece", "start", "length", "ids"])

    return src.mapInArrow(cut, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each size in the given order, and each bin's gap.

    Sizes are between 1 and ``capacity``.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        # Moving a bin from gap g to g - s changes the sum of squares by
        # 2 (N(g - s) - N(g)) + 2, without N(0) in the sum: -2 N(g) + 1 for g = s.
        change = 1 - 2 * count[s:capacity]
        change[1:] += 2 * count[1:capacity - s] + 1
        change[count[s:capacity] == 0] = np.iinfo(np.int64).max
        k = int(change.argmin()) if len(change) else 0
        if len(change) and count[s + k]:
            b = open_bins[s + k].pop()
            count[s + k] -= 1
        else:
            b, k = len(gaps), capacity - s
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gaps[b]
        gaps[b] -= s
        if k:
            count[k] += 1
            open_bins[k].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def _placer(keys: tuple[str, ...], capacity: int, base: int, last: bool, slack: float):
    """The function that packs one group; ``last``: its bins stay as they are, however empty."""
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", *keys, "_row"], ascending=[False] + [True] * (len(keys) + 1))
        bins, offsets, gaps = sum_of_squares(pdf["_size"].to_numpy(), capacity)
        return pd.DataFrame({"_row": pdf["_row"], "sequence_id": 2 * (base + (pdf["_group"].to_numpy() << 30) + bins),
                             "offset": offsets, "_done": last | (gaps[bins] <= slack * capacity)})
    return place


def _dealt(todo: DataFrame, keys: tuple[str, ...], groups: int, rounds: int, items_per_task: int) -> DataFrame:
    """``todo`` with its _group: by a hash of the keys, and by row where equal keys overfill a group."""
    dealt = todo.withColumn("_group", F.pmod(F.xxhash64(*keys, F.lit(rounds)), F.lit(groups)))
    if groups == 1:
        return dealt
    overfull = written(dealt.groupBy("_group").count().where(F.col("count") > 2 * items_per_task)
                       .select("_group", F.lit(True).alias("_overfull")), "overfull")
    if overfull.isEmpty():
        return dealt
    return dealt.join(overfull, "_group", "left").withColumn("_group", F.when(
        F.col("_overfull"), F.pmod(F.xxhash64("_row", F.lit(rounds)), F.lit(groups))).otherwise(F.col("_group"))).drop("_overfull")


def pack(pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece"), size_col: str = "length",
         capacity: int = 1024, items_per_task: int = ITEMS_PER_TASK, slack: float = SLACK) -> DataFrame:
    """``pieces`` with sequence_id and offset; rows and other columns stay as they are."""
    table = written(pieces.drop("sequence_id", "offset", "_row").withColumn("_row", F.monotonically_increasing_id()),
                    "pieces")
    size = F.col(size_col)
    alone = table.where(size >= capacity).withColumns({"sequence_id": F.col("_row") * 2 + 1, "offset": F.lit(0).cast("long")})
    empty = table.where(F.coalesce(size, F.lit(0)) <= 0).withColumns(
        {"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    todo = table.where((size > 0) & (size < capacity)).select("_row", *keys, F.col(size_col).cast("long").alias("_size"))
    n, rounds, placed = todo.count(), 0, []
    while True:
        groups = max(1, -(-n // items_per_task))
        last = groups == 1
        out = _dealt(todo, keys, groups, rounds, items_per_task).groupBy("_group").applyInPandas(
            _placer(keys, capacity, rounds << 50, last, slack), "_row long, sequence_id long, offset long, _done boolean")
        if last:
            placed.append(out.drop("_done"))
            break
        out = written(out, "packed")
        left = out.where("not _done").select("_row")
        n_left = left.count()
        if n_left > (1 - GAIN) * n:
            placed.append(out.drop("_done"))
            break
        placed.append(out.where("_done").drop("_done"))
        if not n_left:
            break
        todo = written(todo.join(left, "_row", "left_semi"), "leftovers")
        n, rounds = n_left, rounds + 1
    sequences = placed[0]
    for more in placed[1:]:
        sequences = sequences.unionByName(more)
    part_filled = table.join(sequences, "_row")
    return alone.unionByName(empty).unionByName(part_filled.select(alone.columns)).drop("_row")


def packed_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    The ids themselves are read again by ``token_pieces``; the layout joins
    them on (id, piece) when sequences are written out, so the packing
    shuffles a few numbers per piece.
    """
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, end_id, capacity) \
        .select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, (id_col, "piece"), "length", capacity)
