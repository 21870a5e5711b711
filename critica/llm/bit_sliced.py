"""Operator 9: exact top-k search by a bit-sliced index.

Components become the integers floor(scale * x); the score is their inner
product.  The index holds, for blocks of rows, one bitmap per attribute
and bit: the slices of the components' upper bits, from an offset that
makes them non-negative.  For a query, the slices are added with the
query's weights by bitmap arithmetic only (full adders over whole
bitmaps), which gives the slices of an upper-bits score of every row of
the block.  The top rows are selected from the most significant slice
downward.  The bits that the index leaves out change a score by no more
than the product of the query's length and the longest remainder of the
block's rows (Cauchy and Schwarz, remainders taken from their middle);
every row within that amount of the k-th best is a boundary row, and
boundary rows are resolved exactly from the integers.  So results are
exact and recall is 1 by construction.

Scale: rows are packed inside the scan's tasks, without a shuffle, into
blocks of ``BLOCK_CELLS`` components, in as few bytes each as they need.
Queries are a stated set and come in chunks of ``CHUNK_CELLS`` components,
up to ``CHUNKS`` of them together, fewer where blocks alone do not keep all
cores busy.  A unit of work is a block with one such set of chunks: a block
travels and is sliced once for all of them, units are dealt over all tasks,
and none holds more than a block and a set.  Each unit gives at most k rows per query, and
the final ranking filters them in the tasks before its shuffle.

Integers beyond ``WIDE`` do not fit the slices' arithmetic.  The rows that
hold one are kept apart in their block as they are, and scored exactly in
Python's integers, as are all rows for a query that holds one.  A score
outside the 64-bit range is given as the nearest 64-bit integer.

Defined results.  Vectors that are null, or hold null, NaN or infinite
components, take no part, as query or as candidate.  Rows of another
length than the query's are compared over the common components (missing
ones are 0).  Ties go to the smaller id.  A candidate with the query's own
id is left out; other rows with equal ids are candidates row by row.
Fewer than k candidates give fewer rows.  Null ids take no part.  Empty
tables give empty results.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critica.llm.store import written

#: Components of a block and of a chunk of queries, and chunks that visit a block together.
BLOCK_CELLS, CHUNK_CELLS, CHUNKS = 1 << 21, 1 << 14, 16
#: Upper bits of a component that the index keeps as slices.
SLICES = 6
#: Integers up to this take part in the sliced arithmetic.
WIDE = 1 << 40
_MOST = (1 << 63) - 1


def exact(vector, scale: float) -> list[int]:
    """floor(scale * x) of every component, in doubles as far as they go."""
    out = []
    for x in vector:
        y = scale * float(x)
        out.append(math.floor(y) if math.isfinite(y) else math.floor(Fraction(float(x)) * Fraction(scale)))
    return out


def exact_score(a: list[int], b: list[int]) -> int:
    return max(-_MOST - 1, min(_MOST, sum(x * y for x, y in zip(a, b))))


def quantised(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[float]]]]:
    """(integer matrix of the ordinary vectors, their row numbers, (row number, vector) of the wide ones)."""
    rows, found, wide = [], [], []
    for i, v in enumerate(vectors.to_pylist()):
        if v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if not np.isfinite(x).all():
            continue
        with np.errstate(over="ignore"):
            a = np.floor(scale * x)
        if (np.abs(a) <= WIDE).all():
            rows.append(a.astype(np.int64))
            found.append(i)
        else:
            wide.append((i, x.tolist()))
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, a in enumerate(rows):
        out[i, :len(a)] = a
    return out, np.array(found, np.int64), wide


class Block:
    """Slices of a block of integer vectors."""

    def __init__(self, values: np.ndarray, n_slices: int = SLICES):
        self.values = values
        n, dims = values.shape
        self.largest = int(np.abs(values).max()) if values.size else 0
        self.low = values.min(axis=0) if n else np.zeros(dims, np.int64)
        shifted = values - self.low
        width = int(shifted.max()).bit_length() if shifted.size else 0
        self.cut = max(0, width - n_slices)
        self.words = -(-n // 64)
        upper = shifted >> self.cut
        self.slices = []
        for d in range(dims):
            bits = [(upper[:, d] >> j) & 1 for j in range(n_slices)]
            self.slices.append([self._bitmap(b.astype(bool)) for b in bits])
        self.valid = self._bitmap(np.ones(n, bool))
        # The left-out bits of a row, from their middle: at most this long.
        rest = (shifted & ((1 << self.cut) - 1)) - ((1 << self.cut) - 1) / 2
        self.rest = float(np.sqrt((rest * rest).sum(axis=1)).max()) if n and dims else 0.0

    def _bitmap(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, bool)
        out[:len(rows)] = rows
        return np.packbits(out, bitorder="little").view(np.uint64)

    def upper_scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the non-negative upper-bits score, what to add to it).

        A negative weight takes the complement of a slice: -w b = w (1 - b) - w.
        """
        columns: dict[int, list[np.ndarray]] = {}
        base = 0
        for d, q in enumerate(query.tolist()):
            if not q or d >= len(self.slices):
                continue
            weight = abs(q)
            for j, s in enumerate(self.slices[d]):
                if q < 0:
                    s = ~s
                    base -= weight << j
                bit = 0
                while weight >> bit:
                    if weight >> bit & 1:
                        columns.setdefault(bit + j, []).append(s)
                    bit += 1
        total, at = [], 0
        while at <= max(columns, default=-1):
            # Full adders take three bitmaps of one weight to one, and carry one to the next weight.
            here = columns.get(at, [])
            carry = columns.setdefault(at + 1, []) if len(here) > 1 else []
            while len(here) > 2:
                a, b, c = here.pop(), here.pop(), here.pop()
                ab = a ^ b
                here.append(ab ^ c)
                carry.append((a & b) | (ab & c))
            if len(here) == 2:
                a, b = here
                carry.append(a & b)
                here = [a ^ b]
            total.append(here[0] if here else np.zeros(self.words, np.uint64))
            at += 1
        return total, base

    def at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """Bitmap of the rows whose sliced score is ``bound`` or more."""
        if bound <= 0:
            return self.valid
        if bound >> len(slices):
            return np.zeros_like(self.valid)
        more, equal = np.zeros_like(self.valid), self.valid
        for j in range(len(slices) - 1, -1, -1):
            if bound >> j & 1:
                equal = equal & slices[j]
            else:
                more = more | (equal & slices[j])
                equal = equal & ~slices[j]
        return more | equal

    def kth_best(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest sliced score, from the most significant slice downward."""
        chosen, equal, value = 0, self.valid, 0
        for j in range(len(slices) - 1, -1, -1):
            ones = equal & slices[j]
            n = int(np.bitwise_count(ones).sum())
            if chosen + n >= k:
                equal, value = ones, value | 1 << j
            else:
                chosen += n
                equal = equal & ~slices[j]
        return value

    def top(self, query: np.ndarray, ids: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows other than those with id ``own``."""
        q = np.zeros(self.values.shape[1], np.int64)
        q[:min(len(q), len(query))] = query[:len(q)]
        need = min(k + int((ids == own).sum()), len(ids))
        slices, _ = self.upper_scores(q)
        bound = self.kth_best(slices, need)
        # In units of the upper-bits score; twice, for the k-th best and for the row compared with it.
        slack = int(np.ceil(2 * self.rest * float(np.sqrt((q * q).sum(dtype=np.float64))) / (1 << self.cut) * (1 + 1e-9)))
        picked = self.at_least(slices, bound - slack)
        rows = np.flatnonzero(np.unpackbits(picked.view(np.uint8), bitorder="little")[:len(ids)])
        rows = rows[ids[rows] != own]
        most = int(np.abs(q).max(initial=0)) * self.largest * max(1, len(q))
        if most <= _MOST:
            scores = self.values[rows] @ q
        else:
            found = [exact_score(v, q.tolist()) for v in self.values[rows].tolist()]
            scores = np.array(found, np.int64)
        order = np.lexsort((ids[rows], -scores))[:k]
        return rows[order], scores[order]


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v")).where("_id is not null")


_PACKED = "ids binary, width int, data binary, wide_ids array<long>, wide array<array<double>>"


def _pack(rows: DataFrame, cells: int, scale: float, out: str) -> DataFrame:
    """(number, ids, width, data, wide_ids, wide): blocks of vectors, packed inside the scan's tasks."""
    def pack(batches):
        ids, values, wide_ids, wide, n = [], [], [], [], 0

        def block():
            width = max((v.shape[1] for v in values), default=0)
            full = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in values]
            most = max((int(np.abs(v).max()) for v in full if v.size), default=0)
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            return pa.RecordBatch.from_arrays([
                pa.array([b"".join(i.astype("<i8").tobytes() for i in ids)], pa.binary()), pa.array([width], pa.int32()),
                pa.array([b"".join(v.astype(kind).tobytes() for v in full)], pa.binary()),
                pa.array([wide_ids], pa.list_(pa.int64())), pa.array([wide], pa.list_(pa.list_(pa.float64())))],
                names=["ids", "width", "data", "wide_ids", "wide"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v, found, apart = quantised(part.column(1), scale)
                own = part.column(0).to_numpy(zero_copy_only=False)
                ids.append(own[found])
                values.append(v)
                wide_ids += [int(own[i]) for i, _ in apart]
                wide += [x for _, x in apart]
                n += max(v.size, len(v)) + sum(len(x) for _, x in apart)
                if n >= cells:
                    yield block()
                    ids, values, wide_ids, wide, n = [], [], [], [], 0
        if n:
            yield block()

    # Full blocks: small partitions are read together.
    total = rows.agg(F.sum(F.size("_v").cast("long"))).first()[0] or 0
    packed = rows.coalesce(max(1, -(-max(0, total) // cells))).mapInArrow(pack, _PACKED)
    return written(packed, out).withColumn("number", F.monotonically_increasing_id())


def _unpacked(ids: bytes, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    kind = f"<i{len(data) // (len(found) * width)}" if len(data) else "<i8"
    return found, np.frombuffer(data, kind).reshape(len(found), width).astype(np.int64)


class Candidates:
    """A block's index and its wide rows."""

    def __init__(self, ids: bytes, width: int, data: bytes, wide_ids, wide, scale: float, n_slices: int):
        self.ids, self.values = _unpacked(ids, width, data)
        self.index = Block(self.values, n_slices) if len(self.ids) else None
        self.wide = [(i, exact(x, scale)) for i, x in zip(wide_ids, wide)]
        self.scale = scale

    def top(self, own: int, query: list[int], wide: bool, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) for a query, ties to the smaller id."""
        apart = self.wide if not wide else self.wide + list(zip(self.ids.tolist(), self.values.tolist()))
        found = [(i, exact_score(v, query)) for i, v in apart if i != own]
        if self.index is not None and not wide:
            rows, scores = self.index.top(np.array(query, np.int64), self.ids, k, own)
            found += zip(self.ids[rows].tolist(), scores.tolist())
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def top_k(queries: DataFrame, table: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, cells: int = BLOCK_CELLS, chunk_cells: int = CHUNK_CELLS, chunks: int = CHUNKS,
          n_slices: int = SLICES) -> DataFrame:
    """(query_id, rank, <id_col>, score): each query's k best rows of ``table``."""
    blocks = _pack(_vectors(table, id_col, vector_col), cells, scale, "bit-blocks")
    asked = _pack(_vectors(queries, id_col, vector_col), chunk_cells, scale, "bit-queries")
    n_blocks, n_asked = max(1, blocks.count()), asked.count()
    # Each set of query chunks goes to each block once, by the block's number.
    cores = table.sparkSession.sparkContext.defaultParallelism
    n_sets = max(1, -(-n_asked // chunks), min(n_asked, -(-cores // n_blocks)))
    sets = asked.withColumn("_set", F.pmod(F.xxhash64("number"), F.lit(n_sets))).groupBy("_set").agg(
        F.collect_list(F.struct("ids", "width", "data", "wide_ids", "wide")).alias("asked"))
    blocks = blocks.withColumn("_group", F.pmod(F.xxhash64("number"), F.lit(n_blocks)))
    units = sets.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))) \
        .join(blocks, "_group").select("number", "_set", "ids", "width", "data", "wide_ids", "wide", "asked") \
        .repartition(max(1, min(4096, n_blocks * n_sets)), "number", "_set")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Candidates(*(batch.column(c)[i].as_py() for c in ("ids", "width", "data", "wide_ids", "wide")), scale, n_slices)
                for part in batch.column("asked")[i]:
                    ids, values = _unpacked(*(part[c].as_py() for c in ("ids", "width", "data")))
                    ask = [(q, v, False) for q, v in zip(ids.tolist(), values.tolist())]
                    ask += [(q, exact(x, scale), True) for q, x in zip(part["wide_ids"].as_py(), part["wide"].as_py())]
                    out = [(q, *x) for q, v, w in ask for x in block.top(q, v, w, k)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)],
                                                     names=["query_id", "_found", "score"])

    found = units.mapInArrow(search, "query_id long, _found long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("_found"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("_found").alias(id_col), "score")
