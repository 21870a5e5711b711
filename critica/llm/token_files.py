"""Operator 2: token files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and as many equal-width ids as fit
(SELECTORS).  Ids of 2^60 and more are escapes: a word with selector 15,
then the id in a word of its own.  The ids are coded in blocks of
``BLOCK`` ids; a block starts on a word of its own and the offset of
every block's first word is stored, so blocks are coded and decoded side
by side in numpy, without a loop over ids.

The files are Parquet files of segments, written by Spark to any store it
can write.  A segment holds whole documents in ascending id order: their
ids and lengths, the block offsets and the coded words.  The parts follow
one another in the order of ``part``, the segments of a part in the order
of ``segment``.

Defined results.  Null text counts as empty (the end id alone).  Rows
with equal ids keep one row each, in the order of their texts; a null id
sorts first.  Other columns are not read.  An empty table gives files
without segments and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from critica.llm import chunks as C
from critica.llm.store import scratch_path

#: Fixed values: (ids per word, bits per id) by selector; 15 is the escape.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8),
             9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 15
#: Ids per block and (about) per segment.
BLOCK = 4096
SEGMENT_IDS = 1 << 20


_SMALL = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id (uint8)."""
    if len(ids) and int(ids.max()) < _SMALL.size:
        return _SMALL[ids.astype(np.int64)]
    out = np.zeros(ids.shape, np.uint8)
    rest = ids.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        big = high > 0
        out[big] += np.uint8(step)
        rest = np.where(big, high, rest)
    return out + (rest > 0).astype(np.uint8)


def _window_max(bits: np.ndarray) -> dict[int, np.ndarray]:
    """Largest bit length of each window of k columns, for every k of SELECTORS."""
    def joined(a, b, shift):
        width = min(a.shape[1], b.shape[1] - shift)
        return np.maximum(a[:, :width], b[:, shift:shift + width])
    m = {1: bits}
    for k, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2),
                    (12, 8, 4), (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30)):
        m[k] = joined(m[a], m[b], a)
    return m


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 words, first word of each block) of unsigned ids."""
    ids = np.asarray(ids).astype(np.uint64)
    n = len(ids)
    n_blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # One row per block; the padding is too wide for any selector, so no word passes a block's end.
    bits = np.full((n_blocks, block + 60), 255, np.uint8)
    lengths = _bit_lengths(ids)
    full = n // block
    bits[:full, :block] = lengths[:full * block].reshape(full, block)
    bits[full:, :n - full * block] = lengths[full * block:]
    select = np.full((n_blocks, block), ESCAPE, np.uint8)
    windows = _window_max(bits)
    for s in sorted(SELECTORS, reverse=True):
        k, width = SELECTORS[s]
        select[windows[k][:, :block] <= width] = s
    counts = np.ones(16, np.int64)
    for s, (k, _) in SELECTORS.items():
        counts[s] = k
    # All blocks take their next word in step.
    at, end = np.arange(n_blocks) * block, np.minimum((np.arange(n_blocks) + 1) * block, n)
    flat, lane, starts, lanes = select.reshape(-1), np.arange(n_blocks), [], []
    while len(at):
        starts.append(at)
        lanes.append(lane)
        at = at + counts[flat[at]]
        more = at < end
        if not more.all():
            at, end, lane = at[more], end[more], lane[more]
    starts, lanes = np.concatenate(starts), np.concatenate(lanes)
    order = np.argsort(starts)
    starts, lanes = starts[order], lanes[order]
    chosen = flat[starts]
    n_words = 1 + (chosen == ESCAPE)
    place = np.cumsum(n_words) - n_words
    words = np.zeros(int(n_words.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        here = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[here]] = np.uint64(ESCAPE << 60)
            words[place[here] + 1] = ids[starts[here]]
            continue
        k, width = SELECTORS[s]
        word = np.full(len(here), s << 60, np.uint64)
        for j in range(k):
            word |= ids[starts[here] + j] << np.uint64(j * width)
        words[place[here]] = word
    first = place[np.searchsorted(lanes, np.arange(n_blocks))]
    return words, first


def decode(words: np.ndarray, first: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of coded words."""
    words = np.asarray(words, np.uint64)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    select = (words >> np.uint64(60)).astype(np.int64)
    if (select == ESCAPE).any():
        # A word after an escape is an id whatever its upper bits say: walk the escapes in order.
        raw = np.zeros(len(words), bool)
        for i in np.flatnonzero(select == ESCAPE).tolist():
            if not raw[i]:
                raw[i + 1] = True
        select[raw] = 0
    counts = np.zeros(16, np.int64)
    for s, (k, _) in SELECTORS.items():
        counts[s] = k
    counts[ESCAPE] = 1
    per_word = counts[select]
    start = np.cumsum(per_word) - per_word
    # The stored offsets locate each block without its predecessors.
    if not np.array_equal(start[np.asarray(first)], np.arange(len(first)) * block):
        raise ValueError("block offsets do not match the words")
    for s in np.unique(select).tolist():
        here = np.flatnonzero(select == s)
        if s == ESCAPE:
            out[start[here]] = words[here + 1]
        elif s:
            k, width = SELECTORS[s]
            mask = np.uint64((1 << width) - 1)
            for j in range(k):
                out[start[here] + j] = (words[here] >> np.uint64(j * width)) & mask
    return out


def decode_block(words: np.ndarray, first: np.ndarray, n: int, which: int, block: int = BLOCK) -> np.ndarray:
    """One block's ids, read through its offset only."""
    end = first[which + 1] if which + 1 < len(first) else len(words)
    return decode(words[first[which]:end], np.zeros(1, np.int64), min(block, n - which * block), block)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> str:
    """Encode whole texts and write them in ascending id order below ``path``."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    src = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text") \
        .withColumn("part", F.spark_partition_id())

    def segment(part, number, doc_ids, ids, lens):
        ids, lens = np.concatenate(ids), np.concatenate(lens)
        words, first = encode(ids)
        own = pa.concat_arrays(doc_ids)
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([lens], pa.list_(pa.int64())),
            pa.array([first], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()], pa.binary())],
            names=["part", "segment", "n_ids", "doc_ids", "lengths", "block_words", "words"])

    def code(batches):
        held, n, part, number = ([], [], []), 0, 0, 0
        for batch in batches:
            for piece in C.slices(batch, "_text"):
                ids, offsets = C.encode_ids(piece.column(1), tokenizer_path, end_id)
                part = piece.column(2)[0].as_py()
                at = 0
                while at < len(piece):
                    # As many whole documents as the segment still takes, one at least.
                    end = int(np.searchsorted(offsets, offsets[at] + max(1, segment_ids - n)))
                    end = min(max(end, at + 1), len(piece))
                    held[0].append(piece.column(0).slice(at, end - at))
                    held[1].append(ids[offsets[at]:offsets[end]])
                    held[2].append(np.diff(offsets[at:end + 1]))
                    n, at = n + int(offsets[end] - offsets[at]), end
                    if n >= segment_ids:
                        yield segment(part, number, *held)
                        held, n, number = ([], [], []), 0, number + 1
        if held[0]:
            yield segment(part, number, *held)

    src.mapInArrow(code, "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, "
                         "block_words array<long>, words binary") \
        .write.option("compression", "zstd").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files; ``ids`` little-endian unsigned 32-bit."""
    files = spark.read.parquet(path)
    # Ids before each part: one row per part.  Ids before each segment within its part.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("segment")
    heads = files.select("part", "segment", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("_inside")) \
        .join(parts, "part").select("part", "segment", (F.col("_before") + F.col("_inside")).alias("_start"))

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lens = batch.column("lengths")[i].values.to_numpy()
                words = np.frombuffer(batch.column("words")[i].as_buffer(), "<u8")
                first = batch.column("block_words")[i].values.to_numpy()
                ids = decode(words, first, int(lens.sum())).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(lens)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lens), batch.column("part")[i].as_py()), pa.int32()),
                    pa.array(np.full(len(lens), batch.column("segment")[i].as_py()), pa.int32()),
                    batch.column("doc_ids")[i].values, pa.array(offsets[:-1]), pa.array(lens),
                    C.binary_column(ids, offsets)],
                    names=["part", "segment", "doc_id", "_offset", "n_tokens", "ids"])

    rows = files.select("part", "segment", "doc_ids", "lengths", "block_words", "words").mapInArrow(
        read, "part int, segment int, doc_id long, _offset long, n_tokens long, ids binary")
    # The digest and the ids stay in place: the small table of segment starts comes to them.
    return rows.join(F.broadcast(heads) if _few(heads) else heads, ["part", "segment"]).select(
        "doc_id", (F.col("_start") + F.col("_offset")).alias("start"), "n_tokens", "ids")


def _few(heads: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of segment starts (two numbers per million ids) is small enough to broadcast."""
    return heads.limit(most + 1).count() <= most


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files (below the checkpoint folder unless ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = write_token_files(docs, path or scratch_path(spark, "tokens"), tokenizer_path, **options)
    return read_token_files(spark, path)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
