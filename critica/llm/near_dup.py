"""Operator 6: MinHash near-duplicates with sequential Bayesian verification.

1. A text's set: distinct hashes (64 bits) of its five-word shingles; with
   fewer words, the whole sequence.  Texts with equal sets (128-bit key)
   form a class; only its first row goes on.
2. A signature of BANDS * ROWS minima per class, cut into bands.  Classes
   that agree in a whole band share a bucket.
3. Candidates are verified in two steps.  Signatures are compared in
   batches; after n hashes with m agreements the posterior probability of
   a similarity of at least T (uniform prior) is P(Binomial(n + 1, T) <= m),
   and a pair is dropped as soon as this falls below MISS.  Survivors are
   verified on their full sets.
4. Verified pairs are links; components are found by label propagation.

Buckets are worked off without emitting the pairs of a group.  First every
bucket compares its members with one of them, its centre; the links found
merge most of a bucket into one component, whose members need no further
comparison.  In a bucket that still holds several components, the members
outside its largest one meet the others in blocks of about BLOCK rows; a
block gives at most one link per component that it joins.  A pair is
tested in the first of its common buckets only.

Chosen misses.  A pair at similarity 0.75 misses all 40 bands of 5 with a
probability of 2e-5, at 0.8 of 1e-7; the Bayesian bound adds at most MISS
per batch.  No link is reported that the full sets do not confirm.

Scale: classes collapse before anything is paired, so thousands of copies
are one row.  Bucket centres are aggregates (a hot bucket is added up in
its tasks), signatures travel once per pair and texts only for survivors.
Every intermediate table is written once to the shared folder.

Defined results.  Null and empty texts, and texts without words, have an
empty set and are linked with nothing; they are their own component.
Repeated rows link with each other.  Rows are told apart by an internal
row number, so equal or null ids are no fault; a component's id is its
smallest id that is not null (null if there is none).  Other columns are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critica.llm import chunks as C
from critica.llm.store import written
from critica.operators.graph import connected_components

WORDS = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
BANDS, ROWS = 40, 5
#: Hashes per batch of the sequential test, and the posterior below which a pair is dropped.
BATCH, MISS = 25, 1e-6
#: Members of a bucket that meet in one unit of work, times two.
BLOCK = 256
SEED = 20_240_601

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[_U(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_U(_BASE), _U(_INVERSE)))


def _of_size(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, n.bit_length()))


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts in order, offsets by text), repetitions included.

    A word's hash is the polynomial over its bytes, taken from running sums; a shingle's mixes its words' hashes.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    with np.errstate(over="ignore"):
        solid = ~_WHITE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(solid & (edge[:n] | ~np.concatenate([[False], solid[:-1]])))
        ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
        power, inverse = _of_size(n)
        run = np.concatenate([[_U(0)], np.cumsum((_LOWER[buf].astype(np.uint64) + _U(1)) * power[:n])])
        word = _mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, offsets)  # first word of each text
        counts = np.diff(first)
        # Long texts: one value per start of a window that stays inside its text.
        total = np.zeros(len(word), np.uint64)
        for k in range(words):
            moved = np.zeros(len(word), np.uint64)
            moved[:len(word) - k] = word[k:]
            total = _mix(total ^ (moved + _U((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
        text = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(word)) - first[text] <= (counts[text] - words)
        # Short texts: the whole sequence, told apart by its length.
        for d in np.flatnonzero((counts > 0) & (counts < words)).tolist():
            value = np.array([_U(counts[d])], np.uint64)
            for w in word[first[d]:first[d + 1]]:
                value = _mix(value ^ (w + _U(0xD1B54A32D192ED03)))
            total[first[d]] = value[0]
            inside[first[d]] = True
    running = np.concatenate([[0], np.cumsum(inside)])
    return total[inside], running[first]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    hashes, offsets = shingle_hashes(*C.raw_bytes(texts))
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


@functools.lru_cache(maxsize=2)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, n, np.uint32))


def signatures(sets: list[np.ndarray], n: int = BANDS * ROWS) -> np.ndarray:
    """(len(sets), n) uint32 minima; an empty set has the largest value throughout."""
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    a, b = _functions(n)
    at = 0
    while at < len(sets):
        # Sets of about 64k values together, so that the working arrays stay in the cache.
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        full = [i for i in range(at, end) if len(sets[i])]
        if full:
            x = (np.concatenate([sets[i] for i in full]) >> _U(32)).astype(np.uint32)
            starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
            work = np.empty_like(x)
            for k in range(n):
                np.multiply(x, a[k], out=work)
                np.bitwise_xor(work, b[k], out=work)
                out[full, k] = np.minimum.reduceat(work, starts)
        at = end
    return out


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, text_hash, n_shingles, set_key, signature) of every row, written once."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text")) \
        .withColumn("text_hash", F.xxhash64(F.coalesce("_text", F.lit(""))))

    def sketch(batches):
        for batch in batches:
            for part in C.slices(batch, "_text", 1 << 20):
                sets = shingle_sets(part.column(1))
                sigs = signatures(sets)
                keys = [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                    # The lower halves tell minima apart.
                    pa.array([s.astype("<u2").tobytes() for s in sigs], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "set_key", "signature"])

    rows = src.mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary")
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "sketches")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) bucket keys of signatures."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), BANDS, ROWS)
        total = np.tile(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), 1))
        for r in range(ROWS):
            total = _mix(total ^ (parts[:, :, r].astype(np.uint64) + _U(0x9E3779B97F4A7C15)))
        return total


def _band_rows(classes: DataFrame) -> DataFrame:
    """(bucket, uid): the buckets of each class."""
    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw = C.raw_bytes(part.column(1))[0]
                keys = band_keys(np.frombuffer(raw.tobytes(), "<u2").reshape(len(part), -1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.reshape(-1).view(np.int64)),
                    part.column(0).take(pa.array(np.repeat(np.arange(len(part)), keys.shape[1])))], names=["bucket", "uid"])

    return classes.select("uid", "signature").mapInArrow(rows, "bucket long, uid long")


def least_matches(percent: int = PERCENT, batch: int = BATCH, n: int = BANDS * ROWS, miss: float = MISS) -> list[int]:
    """Fewest agreements, after each batch, with which a pair stays.

    With a uniform prior, P(similarity >= t | m of k agree) = P(Binomial(k + 1, t) <= m).
    """
    t, out = percent / 100, []
    for k in range(batch, n + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(k + 1, m) * t ** m * (1 - t) ** (k + 1 - m)
        out.append(m)
    return out


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sequential test on signatures does not drop."""
    side = classes.select("uid", "signature", "n_shingles")
    rows = pairs.join(side.toDF("a", "_sa", "_na"), "a").join(side.toDF("b", "_sb", "_nb"), "b") \
        .where(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * PERCENT).select("a", "b", "_sa", "_sb")
    least = least_matches()

    def test(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                sig = [np.frombuffer(C.raw_bytes(part.column(i))[0].tobytes(), "<u2").reshape(len(part), -1) for i in (2, 3)]
                alive = np.arange(len(part))
                agreed = np.zeros(len(part), np.int64)
                for k, m in enumerate(least):
                    span = slice(k * BATCH, (k + 1) * BATCH)
                    agreed[alive] += (sig[0][alive, span] == sig[1][alive, span]).sum(axis=1)
                    alive = alive[agreed[alive] >= m]
                keep = pa.array(alive)
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], names=["a", "b"])

    return rows.mapInArrow(test, "a long, b long")


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, set): the full sets (ascending little-endian 64-bit hashes) of the classes in ``ids``, written once."""
    wanted = classes.select("uid", "doc_id", "text_hash").join(ids, "uid", "left_semi")
    # One text per class, found again by id and hash.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text")) \
        .withColumn("text_hash", F.xxhash64(F.coalesce("_text", F.lit("")))).alias("t") \
        .join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_hash") == F.col("w.text_hash"))) \
        .select("uid", "_text")

    def rows(batches):
        for batch in batches:
            for part in C.slices(batch, "_text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(
                    [x.astype("<u8").tobytes() for x in shingle_sets(part.column(1))], pa.binary())], names=["uid", "set"])

    return written(texts.mapInArrow(rows, "uid long, set binary"), "sets").dropDuplicates(["uid"])


def _agree(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether each of ``others`` links with the set ``x`` (ascending hashes)."""
    sizes = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    both = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= PERCENT * (len(x) + sizes - both)


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link, written once."""
    likely = written(_likely(pairs, classes), "likely")
    rows = likely.join(sets.toDF("b", "_sb"), "b").join(sets.toDF("a", "_sa"), "a").select("a", "b", "_sa", "_sb")

    def verify(batches):
        for batch in batches:
            a = batch.column(0).to_numpy()
            found = np.zeros(len(a), bool)
            # A bucket's centre stands in many pairs; the join brings them one after another.
            runs = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else []
            for lo, hi in zip(runs[:-1], runs[1:]):
                x = np.frombuffer(batch.column(2)[lo].as_buffer(), "<u8")
                found[lo:hi] = _agree(x, [np.frombuffer(batch.column(3)[i].as_buffer(), "<u8") for i in range(lo, hi)])
            keep = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return written(rows.mapInArrow(verify, "a long, b long"), "links")


def block_links(uid: np.ndarray, label: np.ndarray, major: np.ndarray, sig: np.ndarray, sets: list[np.ndarray],
                bucket: int) -> list[tuple[int, int]]:
    """Links that join the components met in one block of a bucket: a forest over the labels.

    A pair is tested in the first of its common buckets only.  Pairs of one
    component are skipped, also when a link found before has made it one.
    """
    names, comp = np.unique(label, return_inverse=True)
    parent = np.arange(len(names))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    band = int(np.flatnonzero(band_keys(sig[:1])[0].view(np.int64) == bucket)[0])
    least, out = least_matches(), []
    size = np.array([len(x) for x in sets])
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for i in np.flatnonzero(~major).tolist():
        others = np.flatnonzero(major | (np.arange(len(uid)) > i))
        roots = np.array([root(c) for c in range(len(names))])[comp]
        others = others[roots[others] != roots[i]]
        others = others[np.minimum(size[others], size[i]) * 100 >= np.maximum(size[others], size[i]) * PERCENT]
        # The first common bucket is this one.
        if band:
            earlier = (parts[others, :band] == parts[i, :band]).all(axis=2).any(axis=1)
            others = others[~earlier]
        agreed = np.zeros(len(others), np.int64)
        for k, m in enumerate(least):
            span = slice(k * BATCH, (k + 1) * BATCH)
            agreed = agreed + (sig[others, span] == sig[i, span]).sum(axis=1)
            others, agreed = others[agreed >= m], agreed[agreed >= m]
        if not len(others):
            continue
        found = others[_agree(sets[i], [sets[j] for j in others])]
        for j in found.tolist():
            x, y = root(comp[i]), root(comp[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(uid[i]), int(uid[j])))
    return out


def _bucket_links(members: DataFrame, classes: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links across the components of open buckets, block by block.

    A bucket's members of its largest component (major) and the others
    (minor) are dealt over blocks of about ``block`` rows.  Minor blocks
    meet each other and the major blocks; major blocks need not meet.
    """
    sizes = members.groupBy("bucket", "label").count()
    of_bucket = sizes.groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("_m"), F.sum("count").alias("_n")) \
        .select("bucket", F.col("_m.label").alias("_major"),
                F.ceil(F.col("_m.count") / block).cast("int").alias("_blocks"),
                F.greatest(F.ceil((F.col("_n") - F.col("_m.count")) / block), F.lit(1)).cast("int").alias("_minors"))
    rows = members.join(of_bucket, "bucket").withColumn("major", F.col("label") == F.col("_major"))
    own = F.pmod(F.xxhash64("uid"), F.when(F.col("major"), F.col("_blocks")).otherwise(F.col("_minors"))).cast("int")
    minors, majors = F.sequence(F.lit(0), F.col("_minors") - 1), F.sequence(F.lit(0), F.col("_blocks") - 1)
    # Units: (i, j) for minor blocks i <= j, and (i, -1 - j) for minor block i and major block j.
    units = F.when(F.col("major"), F.transform(minors, lambda i: F.struct(i.alias("i"), (-1 - F.col("_own")).alias("j")))) \
        .otherwise(F.concat(
            F.transform(minors, lambda i: F.struct(F.least(i, F.col("_own")).alias("i"), F.greatest(i, F.col("_own")).alias("j"))),
            F.transform(majors, lambda j: F.struct(F.col("_own").alias("i"), (-1 - j).alias("j")))))
    rows = rows.withColumn("_own", own).select("bucket", "uid", "label", "major", F.explode(units).alias("_unit")) \
        .select("bucket", F.col("_unit.i").alias("i"), F.col("_unit.j").alias("j"), "uid", "label", "major")
    rows = rows.join(classes.select("uid", "signature"), "uid").join(sets, "uid")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j") \
        .select("bucket", "i", "j", "uid", "label", "major", "signature", "set")

    def unit_links(table: pa.Table):
        if table.num_rows < 2:
            return []
        columns = table.to_pydict()
        return block_links(np.array(columns["uid"]), np.array(columns["label"]), np.array(columns["major"]),
                           np.array([np.frombuffer(x, "<u2") for x in columns["signature"]]),
                           [np.frombuffer(x, "<u8") for x in columns["set"]], columns["bucket"][0])

    def search(batches):
        held: list[pa.RecordBatch] = []
        key, found = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])) if len(keys) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if key is not None and tuple(keys[lo]) != key:
                    found += unit_links(pa.Table.from_batches(held))
                    held = []
                key = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array(
                    [y for _, y in found], pa.int64())], names=["a", "b"])
                found = []
        if held and (found := unit_links(pa.Table.from_batches(held))):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array(
                [y for _, y in found], pa.int64())], names=["a", "b"])

    return written(rows.mapInArrow(search, "a long, b long"), "block-links")


def _relabelled(labels: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """(uid, label) after new links between labels; classes without links have no row."""
    def label(c: str) -> Column:
        return F.coalesce(F.col(f"_l{c}"), F.col(c))
    if labels is None:
        edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    else:
        edges = links.join(labels.toDF("a", "_la"), "a", "left").join(labels.toDF("b", "_lb"), "b", "left").select(
            label("a").alias("src"), label("b").alias("dst"))
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    found = connected_components(nodes, edges).toDF("_old", "_new")
    if labels is None:
        return written(found.toDF("uid", "label"), name)
    kept = labels.join(found, F.col("label") == F.col("_old"), "left").select(
        "uid", F.coalesce("_new", "label").alias("label"))
    fresh = found.toDF("uid", "label").join(labels, "uid", "left_anti")
    return written(kept.unionByName(fresh), name)


def _open_members(members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """(bucket, uid, label) of the buckets whose members are not one component."""
    rows = members.select("bucket", "uid").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    open_buckets = rows.groupBy("bucket").agg(F.min("label").alias("_x"), F.max("label").alias("_y")) \
        .where("_x < _y").select("bucket")
    return written(rows.join(open_buckets, "bucket", "left_semi"), name)


def _some(df: DataFrame) -> bool:
    return not df.isEmpty()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, text_hash, n_shingles, component_id, first) of every row of ``docs``.

    ``first`` marks one row of each component: the one with its smallest id.
    """
    rows = sketched(docs, id_col, text_col)
    first = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("uid").alias("uid"))
    classes = written(rows.join(first.select("uid"), "uid", "left_semi"), "classes")
    bands = _band_rows(classes)
    centres = bands.groupBy("bucket").agg(F.min("uid").alias("_c"), F.count("*").alias("_n")).where("_n > 1")
    members = written(bands.join(centres.select("bucket", "_c"), "bucket"), "buckets")
    sets = _sets(members.select("uid").distinct(), classes, docs, id_col, text_col)

    pairs = members.where("uid <> _c").select(F.col("_c").alias("a"), F.col("uid").alias("b")).distinct()
    labels = _relabelled(None, _links(pairs, classes, sets), "labels")
    members = _open_members(members, labels, "open-buckets")
    if _some(members):
        labels = _relabelled(labels, _bucket_links(members, classes, sets, BLOCK), "more-labels")

    of_class = first.join(labels, "uid", "left").select("set_key", F.coalesce("label", "uid").alias("label"))
    labelled = rows.select("uid", "doc_id", "text_hash", "n_shingles", "set_key").join(of_class, "set_key", "left") \
        .withColumn("label", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("uid")))
    labelled = written(labelled.select("uid", "doc_id", "text_hash", "n_shingles", "label"), "row-labels")
    smallest = labelled.where("n_shingles > 0").groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("_m"))
    smallest = smallest.select("label", F.col("_m.doc_id").alias("_id"), F.col("_m.uid").alias("_uid"))
    out = labelled.join(smallest, "label", "left")
    linked = F.col("n_shingles") > 0
    return out.select("uid", "doc_id", "text_hash", "n_shingles", F.when(linked, F.col("_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      (~linked | (F.col("uid") == F.col("_uid"))).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return components(docs, id_col, text_col).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id.

    Rows with one id and one text are one row here.
    """
    def keyed(df, doc, text_hash):
        return df.withColumns({"_d": F.coalesce(doc, F.lit(0).cast("long")), "_n": doc.isNull(), "_h": text_hash})
    keys = ["_d", "_n", "_h"]
    first = keyed(components(docs, id_col, text_col).where("first"), F.col("doc_id"), F.col("text_hash"))
    rows = keyed(docs, F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return rows.join(first.select(*keys).distinct(), keys).dropDuplicates(keys).select(*docs.columns)
