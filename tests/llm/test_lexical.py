"""Ranked lexical search against a brute-force ranking."""
from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from critica.llm import lexical

from .helpers import awkward_texts, frame, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries: dict = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, q in queries.items():
        scores = []
        for doc, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * big_n) // big_l
            s = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = words(80, seed).split() + ["Äpfel", "ünder", "x_y", "42", "日本"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(25)] + [(7, "dup id"), (None, docs[4][1]), (900, None), (901, "--- !")]
    shared = [" ".join(rng.sample(vocab, 6)) for _ in range(4)]
    items = [(i, " ".join(rng.choice([*shared, *vocab]) for _ in range(rng.randrange(12)))) for i in range(30)]
    return items + [(3, "again the same"), (None, shared[0]), (99, None), (98, "nowhere-to-befound")], docs


def test_equals_brute_force(spark, monkeypatch):
    items, docs = corpus(1)
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(items, docs)
    for cells, item_terms in ((1, 50_000), (1 << 22, 40)):
        monkeypatch.setattr(lexical, "CELLS", cells)
        got = sorted(map(tuple, lexical.rank_documents(i, d, item_terms=item_terms).collect()))
        assert got == want


def test_awkward_rows_and_empty_tables(spark):
    docs = frame(spark, awkward_texts())
    items = spark.createDataFrame([(1, words(40, 1)), (2, "日本語 it's")], "item_id long, text string")
    want = brute([(1, words(40, 1)), (2, "日本語 it's")], list(enumerate(awkward_texts())))
    assert sorted(map(tuple, lexical.rank_documents(items, docs).collect())) == want
    assert lexical.rank_documents(items, docs.limit(0)).count() == 0
    assert lexical.rank_documents(items.limit(0), docs).count() == 0


def test_sharing_changes_no_sum_and_saves_additions():
    rng = random.Random(2)
    sets = [rng.sample(range(60), 8) for _ in range(5)]
    items = []
    for _ in range(40):
        c = Counter(t for s in rng.sample(sets, 2) for t in s)
        c.update(rng.choices(range(60), k=5))
        items.append(dict(c))
    items += [{}, {7: 3}]
    columns = np.random.default_rng(1).integers(0, 1 << 40, (60, 17))
    want = np.stack([sum((columns[t] * n for t, n in i.items()), np.zeros(17, np.int64)) for i in items])
    for among in (0, 3, 64):
        plan = lexical.share_terms(items, among)
        assert (plan.sums(columns) == want).all()
    naive = sum(max(0, sum(i.values()) - 1) for i in items)
    assert lexical.share_terms(items).additions() < 0.6 * naive
    assert len(lexical.share_terms([]).sums(columns)) == 0
