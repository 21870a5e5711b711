"""Operator 11: phrase collocations by SON partitioning.

A phrase is a run of words inside a piece of text, counted per language.
The corpus is cut into shards.  Pass one mines each shard completely, by
length: a phrase is locally frequent if it occurs there at least
``min_count`` times the shard's share of the corpus (in bytes), and a
phrase can only be so if both its halves without the last and without the
first word are.  A phrase that is frequent in the corpus is locally
frequent in one shard at least, so the union of the shards' phrases holds
all frequent ones.  A shard that does not name a phrase has it less often
than its local support.  So the shards of a task, together a larger shard,
give a bound for every phrase, and the task names those that can reach its
own local support (what its shards name is kept in bounded memory, the rest
in a temporary file); phrases of the union that cannot reach ``min_count`` over
all tasks in the same way are left out.  Pass two counts the others in every
shard and adds the counts up exactly; a last step keeps those that reach
``min_count``, scores their cuts and ranks them.

The candidates travel as a bitmap of 2^FILTER_BITS phrase hashes (16 MB at
any size of the corpus).  Equal hashes only mean that a phrase is counted
which is no candidate; the count itself is of the phrase's text, so results
do not depend on hashes.

Scale: a shard is some megabytes of text; a task takes one shard after
another and adds their counts up.  Words are found and phrases counted in
numpy.  What leaves a task is one row per phrase, with its count, however
often a phrase or a copied text occurs.
Beyond corpus bytes / shard bytes > ``min_count`` the local support is a
single occurrence: pass one then names all phrases by hash, in proportion
to the input, and pass two still counts only what can be frequent.

Defined results.  Null text is empty; a null language is ``und``.  Only
A-Z is lower-cased.  Rows are taken one by one: repeated rows and ids
count as often as they stand there.  Equal scores rank by count, then by
the phrase's bytes.  Other columns are not read.  Empty tables and texts
without phrases give empty results.  A text larger than a shard is a shard
of its own.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critica.llm import chunks as C
from critica.llm.store import written
from critica.llm.words import byte_classes, dictionary, split_words

MIN_COUNT = 100
MOST_WORDS = 5
PER_LANGUAGE = 2000
#: Bytes of text of a shard; the last of a task's shards takes along a rest of up to half as much.
SHARD_BYTES = 12 << 20
#: Bytes of text of a task's shards, if there are more of them than cores, and rows that a task adds up before it lets go of them.
TASK_BYTES = 128 << 20
MERGED_ROWS = 1_000_000
#: Named phrases that a task holds before it writes them to its temporary file, and ranges of hashes (a power of two) it reads them in.
HELD_ROWS, HASH_PARTS = 2_000_000, 64
#: Bytes of text that are split into words at once.
SLICE_BYTES = 2 << 20
FILTER_BITS = 27
#: Languages whose totals are broadcast, counted first.
FEW = 100_000

_CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last, and that of its last word."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _numbered(codes: np.ndarray, parts: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, number of each code, counts); sorted in parts, which takes little memory."""
    number = np.empty(len(codes), np.int32)
    distinct, counts, base = [], [], 0
    which = (codes % parts).astype(np.uint8)
    for r in range(parts):
        here = np.flatnonzero(which == r).astype(np.int32)
        own = codes[here]
        order = np.argsort(own)
        own, here = own[order], here[order]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        starts = np.flatnonzero(new)
        number[here] = np.cumsum(new, dtype=np.int32) + np.int32(base - 1)
        distinct.append(own[starts])
        counts.append(np.diff(np.append(starts, len(own))).astype(np.int32))
        base += len(starts)
    return np.concatenate(distinct), number, np.concatenate(counts)


class Shard:
    """Words of consecutive slices of a table as numbers, with their language and where pieces start."""

    def __init__(self):
        self.languages: dict[str, int] = {}
        self.vocabulary: dict[bytes, int] = {}
        self.words, self.language, self.starts, self.bytes = [], [], [], 0

    def add(self, languages: pa.Array, texts: pa.Array) -> None:
        coded = languages.dictionary_encode()
        own = [self.languages.setdefault(x, len(self.languages)) for x in coded.dictionary.to_pylist()]
        of_row = np.array(own, np.int16 if len(self.languages) < 1 << 15 else np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
        words, row, piece = split_words(texts, _CLASSES)
        index, distinct = dictionary(words)
        number = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in distinct.to_pylist()], np.int32)
        self.words.append(number[index] if len(index) else np.zeros(0, np.int32))
        self.language.append(of_row[row])
        starts = np.ones(len(piece), bool)
        starts[1:] = piece[1:] != piece[:-1]
        self.starts.append(starts)
        self.bytes += int(C.raw_bytes(texts)[1][-1])

    def merge(self, other: Shard) -> None:
        order = np.array([self.languages.setdefault(x, len(self.languages)) for x in other.languages], np.int32)
        number = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in other.vocabulary], np.int32)
        self.words += [number[x] if len(x) else x for x in other.words]
        self.language += [order[x] if len(x) else x for x in other.language]
        self.starts += other.starts
        self.bytes += other.bytes

    def levels(self, keep, most_words: int = MOST_WORDS):
        """(before, last, counts, hashes) of the kept phrases, length by length.

        ``keep(counts, hashes)`` tells which of the distinct phrases of a
        length stay; longer ones are only sought around those.  ``before``
        and ``last``: the kept phrase that a phrase is without its last
        word, and that word among the kept words; for words themselves the
        numbers of their language and word.
        """
        n = sum(map(len, self.words))
        if not n:
            return
        texts = list(self.vocabulary)
        starts = np.append(np.concatenate(self.starts), True)
        codes = np.concatenate([g.astype(np.int64) * len(texts) + w for g, w in zip(self.language, self.words)])
        self.words = self.language = self.starts = ()
        distinct, ids, counts = _numbered(codes)
        lang, word = distinct // len(texts), distinct % len(texts)
        seeds = [xxhash.xxh64_intdigest(x.encode()) for x in self.languages]
        one = np.fromiter((xxhash.xxh64_intdigest(texts[w], seeds[g]) for w, g in zip(word.tolist(), lang.tolist())),
                          np.uint64, len(word))
        self.texts = texts
        del codes
        hashes = one
        gram = ids  # the phrase at each place
        for length in range(1, most_words + 1):
            if length > 1:
                # A phrase at a place: the shorter ones at the place and at the next are kept, and no piece ends between.
                ok = here[:-1] & here[1:]
                if length == 2:
                    ok &= ~starts[1:]
                    gram = ids.copy()
                at = np.flatnonzero(ok).astype(np.int32)
                codes = gram[at].astype(np.int64)
                codes *= len(one)
                codes += ids[at + np.int32(length - 1)]
                distinct, number, counts = _numbered(codes)
                del codes
                kept = np.zeros(len(distinct), bool)
                for lo in range(0, len(distinct), 1 << 18):
                    part = slice(lo, lo + (1 << 18))
                    kept[part] = keep(counts[part], _mixed(hashes[distinct[part] // len(one)], one[distinct[part] % len(one)]))
                # Only the kept ones get words, and numbers of their own.
                here = np.zeros(n + 1, bool)
                here[at] = kept[number]
                gram[at] = (np.cumsum(kept, dtype=np.int32) - 1)[number]
                distinct, counts = distinct[kept], counts[kept]
                del number, kept, at
                before, end = distinct // len(one), distinct % len(one)
                hashes = _mixed(hashes[before], one[end])
                if len(counts):
                    # Numbers among the kept ones of the length before.
                    yield before if length > 2 else kept_word[before], kept_word[end], counts, hashes
            else:
                kept = keep(counts, hashes)
                kept_word = np.cumsum(kept, dtype=np.int32) - 1
                if kept.any():
                    yield lang[kept], word[kept], counts[kept], hashes[kept]
                here = np.append(kept[ids], False)
            if not here.any():
                return

    def totals(self) -> list[tuple[str, int]]:
        """(language, words)."""
        counts = sum((np.bincount(x, minlength=len(self.languages)) for x in self.language), np.zeros(len(self.languages), np.int64))
        return list(zip(self.languages, counts.tolist()))


class Tally:
    """Counts of phrases over the shards of a task, in numbers: a phrase is the one before its last word, and that word."""

    def __init__(self):
        self.words: dict[tuple[str, bytes], int] = {}
        self.word_counts: list[int] = []
        self.totals: dict[str, int] = {}
        # By length from 2 on: sorted codes with their numbers, and counts, shorter phrase and last word by number.
        self.codes, self.numbers, self.counts, self.before, self.last = ({} for _ in range(5))

    def __len__(self):
        return len(self.words) + sum(map(len, self.counts.values()))

    def add(self, shard: Shard, keep, most_words: int) -> None:
        for name, n in shard.totals():
            self.totals[name] = self.totals.get(name, 0) + n
        names, of_word, of_before = list(shard.languages), None, None
        for length, (before, last, counts, _) in enumerate(shard.levels(keep, most_words), 1):
            if length == 1:
                of_word = np.array([self.words.setdefault((names[g], shard.texts[w]), len(self.words))
                                    for g, w in zip(before.tolist(), last.tolist())], np.int64)
                self.word_counts += [0] * (len(self.words) - len(self.word_counts))
                for i, c in zip(of_word.tolist(), counts.tolist()):
                    self.word_counts[i] += c
                of_before = of_word
            else:
                of_before = self._added(length, of_before[before], of_word[last], counts)

    def _added(self, length: int, before: np.ndarray, last: np.ndarray, counts: np.ndarray) -> np.ndarray:
        codes = before << 32 | last
        empty = np.zeros(0, np.int64)
        known, numbers, totals = (x.get(length, empty) for x in (self.codes, self.numbers, self.counts))
        at = np.searchsorted(known, codes)
        found = np.zeros(len(codes), bool)
        inside = at < len(known)
        found[inside] = known[at[inside]] == codes[inside]
        out = np.empty(len(codes), np.int64)
        out[found] = numbers[at[found]]
        new = ~found
        out[new] = len(totals) + np.arange(int(new.sum()))
        totals = np.concatenate([totals, np.zeros(int(new.sum()), np.int64)])
        totals[out] += counts
        merged = np.concatenate([known, codes[new]])
        order = np.argsort(merged, kind="stable")
        self.codes[length], self.numbers[length], self.counts[length] = merged[order], np.concatenate([numbers, out[new]])[order], totals
        self.before[length] = np.concatenate([self.before.get(length, empty), before[new]])
        self.last[length] = np.concatenate([self.last.get(length, empty), last[new]])
        return out

    def batches(self, rows: int = 1 << 16):
        """(lang, phrase, n_words, f) of everything counted; a row with 0 words holds a language's number of words."""
        def batch(languages, phrases, n, counts):
            return pa.RecordBatch.from_arrays([
                languages, phrases, pa.array(np.full(len(counts), n), pa.int32()), pa.array(counts, pa.int64())],
                names=["lang", "phrase", "n_words", "f"])

        if self.totals:
            yield batch(pa.array(list(self.totals), pa.string()), pa.array([""] * len(self.totals), pa.string()), 0, list(self.totals.values()))
        language = pa.array([g for g, _ in self.words], pa.string()).dictionary_encode()
        word = pa.array([w for _, w in self.words], pa.binary()).cast(pa.string())
        texts, lang = word, language
        for length in range(1, 1 + max([1, *self.counts])):
            if length > 1:
                before, last = pa.array(self.before[length]), pa.array(self.last[length])
                texts, lang = pc.binary_join_element_wise(texts.take(before), word.take(last), " "), lang.take(before)
            counts = np.array(self.word_counts, np.int64) if length == 1 else self.counts[length]
            for at in range(0, len(counts), rows):
                yield batch(lang[at:at + rows].cast(pa.string()), texts[at:at + rows], length, counts[at:at + rows])


def _shards(batches, size: int):
    """Shards of about ``size`` bytes; a small rest of a task goes to its last one."""
    ready, now = None, Shard()
    for batch in batches:
        for piece in C.slices(batch, "_text", SLICE_BYTES):
            now.add(piece.column("lang"), piece.column("_text"))
            if ready is not None and now.bytes > size // 2:
                yield ready
                ready = None
            if now.bytes >= size:
                ready, now = now, Shard()
    if ready is not None:
        ready.merge(now)
    yield ready or now


class Named:
    """(hash, count, slack) of the phrases that the shards of a task name, summed over each hash.

    At a local support of one a task names about as many phrases as its text
    has words of all lengths.  Beyond ``held`` rows they are summed, sorted
    and written to a temporary file; ``parts`` reads them back by ranges of
    the hash, so that memory is bounded at any number of shards.
    """

    KIND = np.dtype([("hash", np.int64), ("count", np.int32), ("slack", np.int32)])

    def __init__(self, held: int):
        self.held, self.rows, self.now, self.file, self.runs = held, 0, [], None, []
        self.bounds = np.arange(1 - HASH_PARTS // 2, HASH_PARTS // 2, dtype=np.int64) * (1 << 64 - HASH_PARTS.bit_length() + 1)

    def add(self, hashes: np.ndarray, counts: np.ndarray, slack: int) -> None:
        for at in range(0, len(hashes), self.held):
            part = np.empty(len(hashes[at:at + self.held]), self.KIND)
            part["hash"], part["count"], part["slack"] = hashes[at:at + self.held], counts[at:at + self.held], slack
            self.now.append(part)
            self.rows += len(part)
            if self.rows > self.held:
                self._spill()

    def _summed(self, parts: list) -> np.ndarray:
        rows = np.concatenate(parts or [np.empty(0, self.KIND)])
        parts.clear()
        order = np.argsort(rows["hash"])
        rows = rows[order]
        starts = np.flatnonzero(np.append(True, rows["hash"][1:] != rows["hash"][:-1])) if len(rows) else np.zeros(0, np.int64)
        out = rows[starts]
        for c in ("count", "slack") if len(starts) < len(rows) else ():
            out[c] = np.add.reduceat(rows[c], starts, dtype=np.int32)
        return out

    def _spill(self) -> None:
        rows = self._summed(self.now)
        self.file = self.file or tempfile.TemporaryFile()
        self.runs.append((self.file.seek(0, 2), np.concatenate([[0], np.searchsorted(rows["hash"], self.bounds), [len(rows)]])))
        self.file.write(rows)
        self.rows = 0

    def parts(self):
        """The rows, each hash once."""
        if self.file is None:
            yield self._summed(self.now)
            return
        self._spill()
        for r in range(HASH_PARTS):
            found = []
            for at, cuts in self.runs:
                self.file.seek(at + int(cuts[r]) * self.KIND.itemsize)
                found.append(np.frombuffer(self.file.read(int(cuts[r + 1] - cuts[r]) * self.KIND.itemsize), self.KIND))
            yield self._summed(found)
        self.file.close()


def _named(batches, least, most_words: int, shard_bytes: int):
    """(hash, f, slack) of the phrases that a task names; first the task itself, as a row without a hash."""
    found, size, slack = Named(HELD_ROWS), 0, 0
    for shard in _shards(batches, shard_bytes):
        size += shard.bytes
        # A task's small rest names no more than a full shard, as far as the task's own least count allows.
        own = max(1, min(least(max(shard.bytes, shard_bytes)), least(size) - slack))
        slack += own - 1
        for _, _, counts, hashes in shard.levels(lambda counts, _: counts >= own, most_words):
            found.add(hashes.view(np.int64), counts, own - 1)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([least(size) - 1], pa.int64())],
                                     names=["hash", "f", "slack"])
    for rows in found.parts():
        most = rows["count"].astype(np.int64) + slack - rows["slack"]
        keep = most >= least(size)
        hashes, most = rows["hash"][keep], most[keep]
        for at in range(0, len(hashes), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[part]), pa.array(most[part]),
                                              pa.array(np.full(len(hashes[part]), least(size) - 1), pa.int64())], names=["hash", "f", "slack"])


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def candidate_filter(rows: DataFrame, total: int, min_count: int, most_words: int, shard_bytes: int,
                     bits: int) -> np.ndarray:
    """Bitmap (bytes) over the hashes of the phrases that can be frequent.

    A shard of least count t has a phrase that it does not name t - 1 times
    at most.  So a task knows a bound for every phrase over its shards, and
    names those whose bound reaches the task's own least count.
    """
    def least(size: int) -> int:
        return max(1, -(-min_count * size // max(total, 1)))

    def mine(batches):
        return _named(batches, least, most_words, shard_bytes)

    named = written(rows.mapInArrow(mine, "hash long, f long, slack long").groupBy("hash").agg(
        F.sum("f").alias("f"), F.sum("slack").alias("slack")), "phrase-candidates")
    slack = named.where("hash is null").agg(F.sum("slack")).first()[0] or 0
    able = named.where(F.col("hash").isNotNull() & (F.col("f") + slack - F.col("slack") >= min_count))
    slot = F.shiftrightunsigned("hash", 64 - bits)
    words = able.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    found = words.toArrow()  # 2^(bits - 6) rows at most
    out = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                  most_words: int = MOST_WORDS, shard_bytes: int = SHARD_BYTES, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, n_words, f) of all phrases of up to ``most_words`` words with f >= min_count.

    A row with 0 words holds a language's number of words.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    # Small partitions are read together, without a shuffle: full shards, and what a task's shards share leaves it once.
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(max(1, min(cores, math.ceil(total / shard_bytes)), math.ceil(total / TASK_BYTES)))
    bitmap = candidate_filter(rows, total, min_count, most_words, shard_bytes, bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def count(batches):
        filled = np.frombuffer(shared.value, np.uint8)

        def candidates(_, hashes):
            slot = _slots(hashes, bits)
            return (filled[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

        tally = Tally()
        for shard in _shards(batches, shard_bytes):
            tally.add(shard, candidates, most_words)
            if len(tally) > MERGED_ROWS:
                yield from tally.batches()
                tally = Tally()
        yield from tally.batches()

    counted = rows.mapInArrow(count, "lang string, phrase string, n_words int, f long")
    return counted.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where(
        (F.col("n_words") == 0) | (F.col("f") >= min_count))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 most_words: int = MOST_WORDS, per_language: int = PER_LANGUAGE, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words or more.

    ``a``: the phrase's count; ``l``, ``r``: those of the two parts at the
    cut with the lowest score floor(1000 a n / (l r)), n being the
    language's words.  A phrase inside a longer frequent one that occurs as
    often is left out.
    """
    counts = written(phrase_counts(docs, text_col, lang_col, min_count, most_words, **options), "phrases")
    n = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where(F.col("n_words").between(1, most_words - 1)).select("lang", "phrase", "f")
    phrases = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"),
                                                 F.split("phrase", " ").alias("_words"))

    def run(first, length):
        return F.array_join(F.slice("_words", first, length), " ")

    cuts = phrases.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "a", "_cut", run(F.lit(1), F.col("_cut")).alias("_left"),
        run(F.col("_cut") + 1, F.col("n_words") - F.col("_cut")).alias("_right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"]) \
        .join(parts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"]) \
        .join(_sized(n), "lang")
    # Products of up to 38 digits; the quotient is at most 1000 n.
    score = F.expr("(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "_cut", "l", "r")).alias("_best"))
    inner = phrases.where("n_words > 2").select("lang", "a", "_words", "n_words", F.explode(
        F.sequence(F.lit(2), F.col("n_words") - 1)).alias("_length")) \
        .select("lang", "a", "_words", "_length", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("_length") + 1)).alias("_first")) \
        .select("lang", run(F.col("_first"), F.col("_length")).alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    alone = scored.join(inner, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") < F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return alone.select("lang", "phrase", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), "n",
                        F.col("_best.score").alias("score")) \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_language) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
