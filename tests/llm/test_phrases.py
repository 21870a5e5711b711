"""Phrase collocations against a brute-force count."""
from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from critica.llm import phrases
from critica.llm.words import byte_classes, split_words

from .helpers import awkward_texts, frame, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, per_language=2000):
    f: dict = {}
    n: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        longest: dict = {}
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i:i + k]] = max(longest.get(p[i:i + k], 0), a)
        scored = []
        for p, a in cands.items():
            if longest.get(p, -1) >= a:
                continue
            s, k = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for r, (s, a, p, lo, hi) in enumerate(sorted(scored)[:per_language], 1):
            out.append((lang, r, p.decode(), -a, lo, hi, n[lang], -s))
    return sorted(out)


def _texts(seed):
    rng = random.Random(seed)
    common = ["the big dog", "New  York City", "a a a a", "über\tden Fluß", "x. y, z", "Ünder a b c d e f"]
    return [" ".join(rng.choice(common + ["w%d" % rng.randrange(30), "\n", "!"]) for _ in range(rng.randrange(40)))
            for _ in range(120)]


def test_equals_brute_force_over_many_small_shards(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de", None, ""]), t) for t in _texts(1)] + [("en", None), ("fr", ""), (None, " .,. ")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for shard_bytes in (1, 600, 1 << 20):
        got = phrases.collocations(docs, min_count=7, shard_bytes=shard_bytes, bits=12)
        assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_local_support_prunes_but_loses_nothing(spark):
    rows = [("en", t) for t in _texts(2) * 6]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    text = docs.selectExpr("lang", "text as _text")
    total = sum(len(t.encode()) for _, t in rows)
    low = int(np.unpackbits(phrases.candidate_filter(text, total, 1, 5, 2000, 20)).sum())
    high = int(np.unpackbits(phrases.candidate_filter(text, total, 90, 5, 2000, 20)).sum())
    assert 0 < high < low
    got = phrases.collocations(docs, min_count=90, shard_bytes=2000)
    assert sorted(map(tuple, got.collect())) == brute(rows, 90)


def test_ranks_are_cut_and_ties_go_by_bytes(spark):
    rows = [("en", "é b. z b. a b")] * 10
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(docs, min_count=10, per_language=2).collect()
    assert [(r.rank, r.phrase) for r in got] == [(1, "a b"), (2, "z b")]


def test_awkward_rows_and_empty_table(spark):
    docs = frame(spark, awkward_texts() * 3)
    got = phrases.collocations(docs, min_count=3)
    assert sorted(map(tuple, got.collect())) == brute([(None, t) for t in awkward_texts() * 3], 3)
    assert phrases.collocations(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None)], "lang string, text string")
    assert phrases.collocations(nulls).count() == 0


def test_split_words_over_slices():
    table = byte_classes(b" \t", b".\n")
    texts = pa.array(["zero", None, "A b.c", "", "  ", "Straße\tÉ", ".x"])[1:]
    found, row, piece = split_words(texts, table)
    assert [w.decode() for w in found.to_pylist()] == ["a", "b", "c", "straße", "É", "x"]
    assert row.tolist() == [1, 1, 1, 4, 4, 5]
    assert [x == y for x, y in zip(piece, piece[1:])] == [True, False, False, True, False]
    long = words(5000, 9)
    assert len(split_words(pa.array([long]), table)[0]) == 5000


def test_named_phrases_leave_memory_and_come_back_summed(monkeypatch):
    rng = np.random.default_rng(4)
    kept, want = phrases.Named(100), {}
    for shard in range(9):
        hashes = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 300)[rng.integers(0, 300, 250)] >> rng.integers(0, 60))
        hashes = np.append(hashes, [-(1 << 63), 0, (1 << 63) - 1])
        hashes = np.unique(hashes)
        counts = rng.integers(1, 50, len(hashes)).astype(np.int32)
        kept.add(hashes, counts, shard % 3)
        assert kept.rows <= 100 and sum(map(len, kept.now)) <= 100
        for h, c in zip(hashes.tolist(), counts.tolist()):
            old = want.get(h, (0, 0))
            want[h] = (old[0] + c, old[1] + shard % 3)
    parts = list(kept.parts())
    assert len(parts) == phrases.HASH_PARTS
    got = [tuple(r) for p in parts for r in p.tolist()]
    assert len(got) == len(want) and {h: (c, s) for h, c, s in got} == want

    text = [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([t])], names=["lang", "_text"]) for t in _texts(5)]

    def named():
        rows = pa.Table.from_batches(phrases._named(iter(text), lambda size: max(1, size // 2000), 5, 500)).to_pylist()
        return rows[0], sorted((r["hash"], r["f"], r["slack"]) for r in rows[1:])

    whole = named()
    monkeypatch.setattr(phrases, "HELD_ROWS", 64)
    assert named() == whole and whole[0]["hash"] is None and whole[1]
