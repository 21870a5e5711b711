"""Operator 13: ranked lexical search of many queries at once, sharing subexpressions.

The items of a benchmark are sums over their terms, and items share terms.
``share_terms`` mines the term sets that several items have in common:
terms of exactly the same items become one node, then the pair of nodes
that most items have together becomes a node, again and again.  The result
is a directed graph: term columns below, shared sums above them, items on
top.  For a block of documents every node's partial accumulator (one
integer per document) is added up once and used by all nodes and items
above it.

The documents are read twice: once for the tokens (what is kept of a
document are its length and the counts of query terms), and once, from
those counts, for the scores, when N, L and the document frequencies are
known.  All arithmetic is in 64-bit integers, so sharing changes no score.

Scale: items are a stated query set; they are worked off in blocks of
about ``ITEM_TERMS`` (item, term) pairs, by a hash of the item, so what the
driver holds and every task gets is bounded whatever the number of items.
Documents never meet each other: a task gives at most k rows per item, and
the last ranking filters before its shuffle.  Statistics are plain
aggregates over all documents.

Defined results.  Null text has no terms; documents without terms count
nowhere and are never found.  A document with a null id counts in the
statistics and is not returned; rows with equal ids are ranked row by row.
Rows with equal item ids are one item with the terms of all of them; items
with a null id or without terms give no rows.  Equal scores rank by
ascending document id.  Scores of 0 are left out.  Other columns are not
read.  Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critica.llm import chunks as C
from critica.llm.store import written
from critica.llm.words import byte_classes, dictionary, split_words

#: (item, term) pairs of a block of items.
ITEM_TERMS = 50_000
#: Nodes of an item, the ones in most items, among which pairs are sought.
PAIRS_AMONG = 64
#: 64-bit cells of a block of documents.
CELLS = 4 << 20

_TERMS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CLASSES = byte_classes(bytes(b for b in range(128) if b not in _TERMS))


class SharedPlan:
    """Sums of term columns for a set of items, common parts first.

    ``leaves``: term number of each leaf.  ``nodes``: the leaves and earlier
    nodes (numbered after the leaves) that a node adds up.  ``items``: the
    leaves and nodes that an item adds up.
    """

    def __init__(self, leaves: list[int], nodes: list[list[int]], items: list[list[int]]):
        self.leaves, self.nodes, self.items = np.array(leaves, np.int64), nodes, items

    def sums(self, columns: np.ndarray) -> np.ndarray:
        """(items x documents) sums of a (terms x documents) array."""
        done = np.empty((len(self.leaves) + len(self.nodes), columns.shape[1]), np.int64)
        done[:len(self.leaves)] = columns[self.leaves]
        for i, parts in enumerate(self.nodes, len(self.leaves)):
            np.add.reduce(done[parts], axis=0, out=done[i])
        return np.stack([done[parts].sum(axis=0) for parts in self.items]) if self.items else done[:0]

    def additions(self) -> int:
        return sum(len(x) - 1 for x in self.nodes) + sum(len(x) - 1 for x in self.items)


def share_terms(items: list[dict[int, int]], pairs_among: int = PAIRS_AMONG) -> SharedPlan:
    """The plan for items given as {term: times}."""
    # A term's first, second, ... occurrence in an item are different leaves.
    where: dict[tuple[int, int], list[int]] = {}
    for i, terms in enumerate(items):
        for t, times in sorted(terms.items()):
            for j in range(times):
                where.setdefault((t, j), []).append(i)
    leaves = sorted(where)
    bundles: dict[tuple[int, ...], list[int]] = {}
    for number, leaf in enumerate(leaves):
        bundles.setdefault(tuple(where[leaf]), []).append(number)
    nodes: list[list[int]] = []
    has: list[set[int]] = [set() for _ in items]
    users: dict[int, set[int]] = {}

    def node(parts: list[int], of: set[int]) -> int:
        number = parts[0]
        if len(parts) > 1:
            nodes.append(parts)
            number = len(leaves) + len(nodes) - 1
        users[number] = set(of)
        for i in of:
            has[i].add(number)
        return number

    for of, parts in sorted(bundles.items()):
        node(parts, set(of))
    # Pairs among the most shared nodes of each item; a node of one item is in no pair worth having.
    mined = [set(sorted((x for x in own if len(users[x]) > 1), key=lambda x: (-len(users[x]), x))[:pairs_among]) for own in has]
    pairs: Counter = Counter()
    for own in mined:
        pairs.update(combinations(sorted(own), 2))
    queue = [(-c, p) for p, c in pairs.items() if c > 1]
    heapq.heapify(queue)
    while queue:
        count, (x, y) = heapq.heappop(queue)
        if pairs[x, y] != -count:  # outdated; its present count is queued
            continue
        of = {i for i in users[x] & users[y] if x in mined[i] and y in mined[i]}
        new = node([x, y], of)
        changed = set()
        for i in of:
            mined[i] -= {x, y}
            has[i] -= {x, y}
            for gone in (x, y):
                for o in mined[i]:
                    p = (min(gone, o), max(gone, o))
                    pairs[p] -= 1
                    changed.add(p)
            for o in mined[i]:
                p = (o, new)
                pairs[p] += 1
                changed.add(p)
            mined[i].add(new)
        users[x] -= of
        users[y] -= of
        pairs[x, y] = 0
        for p in sorted(changed):
            if pairs[p] > 1:
                heapq.heappush(queue, (-pairs[p], p))
    return SharedPlan([t for t, _ in leaves], nodes, [sorted(x) for x in has])


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, times)."""
    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("_text")) \
        .where("item is not null")

    def terms(batches):
        for batch in batches:
            for piece in C.slices(batch, "_text"):
                words, row, _ = split_words(piece.column(1), _CLASSES)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), words.cast(pa.string())],
                                                 names=["item", "term"])

    return rows.mapInArrow(terms, "item long, term string").groupBy("item", "term").agg(F.count("*").alias("times"))


def _occurrences(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc, n, terms, counts) of all documents with a term: which query terms they hold how often."""
    known = pa.array([t.encode() for t in vocabulary], pa.large_binary())
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        query = shared.value
        for batch in batches:
            for piece in C.slices(batch, "_text"):
                words, row, _ = split_words(piece.column(1), _CLASSES)
                index, distinct = dictionary(words)
                number = pc.fill_null(pc.index_in(distinct, value_set=query), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                of = number[index] if len(index) else np.zeros(0, np.int64)
                hit = of >= 0
                pair, times = np.unique(row[hit] * max(1, len(query)) + of[hit], return_counts=True)
                per_row = np.bincount(pair // max(1, len(query)), minlength=len(piece))
                n = np.bincount(row, minlength=len(piece))
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32())
                out = pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(pair % max(1, len(query)), pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], names=["doc", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(count, "doc long, n long, terms array<int>, counts array<long>")


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each item, ties by document."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return item[place < k], score[place < k], doc[place < k]


def _block(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(item_id, _doc, score): the k best of each task for one block of items, given as (item, term, times)."""
    rows = items.collect()  # about ITEM_TERMS
    vocabulary = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = sorted({r["item"] for r in rows})
    place = {x: i for i, x in enumerate(ids)}
    terms: list[dict[int, int]] = [{} for _ in ids]
    for r in rows:
        terms[place[r["item"]]][number[r["term"]]] = r["times"]
    plan = share_terms(terms)
    held = written(_occurrences(docs, vocabulary), "lexical-counts")
    n_docs, length = held.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, c in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a query term
        df[t] = c
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((plan, weights, np.array(ids, np.int64)))
    n_docs, length = int(n_docs), int(length or 1)

    def search(batches):
        plan, w, ids = shared.value
        step = max(64, CELLS // max(1, len(w) + len(plan.leaves) + len(plan.nodes) + len(ids)))
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                part = part.filter(pc.is_valid(part.column(0)))
                doc = part.column(0).to_numpy(zero_copy_only=False)
                m = 25 + (75 * part.column(1).to_numpy(zero_copy_only=False) * n_docs) // length
                per_row = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(doc)), per_row)
                term = part.column(2).flatten().to_numpy(zero_copy_only=False)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)
                columns = np.zeros((len(w), len(doc)), np.int64)
                columns[term, row] = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                scores = plan.sums(columns)
                if len(doc) > k:
                    least = np.partition(scores, len(doc) - k, axis=1)[:, len(doc) - k]
                else:
                    least = np.zeros(len(ids), np.int64)
                item, found = np.nonzero(scores >= np.maximum(least, 1)[:, None])
                best = _best(*(np.concatenate([x, y]) for x, y in zip(best, (item, scores[item, found], doc[found]))), k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), pa.array(best[1])],
                                         names=["item_id", "_doc", "score"])

    return held.mapInArrow(search, "item_id long, _doc long, score long")


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", item_text_col: str = "text",
                   doc_col: str = "doc_id", text_col: str = "text", item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, <doc_col>, score): each item's k documents of highest score."""
    terms = written(_item_terms(items, item_col, item_text_col), "lexical-items")
    rows = docs.select(F.col(doc_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    blocks = max(1, math.ceil(terms.count() / item_terms))
    found = None
    for b in range(blocks):
        part = _block(terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), rows, k)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("_doc"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col("item_id").alias("item_id"), "rank", F.col("_doc").alias(doc_col), "score")
