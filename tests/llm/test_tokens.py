"""Operators 1, 2, 5, 7: exact ids, layouts, files, prefix counts and segmentations."""
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from critica.llm import chunks, nbest, packing, prefix_counts, token_files
from tests.llm.helpers import BYTE_BPE, PIECE_BPE, awkward_texts, frame

TEXT = st.text(alphabet="ab e'rstvl.,  \n\t1é日<|endoftext|>", max_size=40)


def ids_of(text):
    return chunks.library_tokenizer(BYTE_BPE).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_chunked_ids_are_the_librarys(texts):
    ids, offsets = chunks.encode_ids(pa.array(texts, pa.string()), BYTE_BPE, 7)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(t) + [7] for t in texts]


def test_packing_layout(spark):
    texts = awkward_texts()
    got = packing.packed_documents(frame(spark, texts), BYTE_BPE, end_id=2, capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, pieces = ids_of(t) + [2], sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.length for p in pieces[1:]] == [64] * (len(pieces) - 1) and len(pieces) == -(-len(ids) // 64)
        at = 0
        for p in pieces:
            assert p.start == at and p.ids_crc32 == crc(ids[at:at + p.length])
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_packing_rule_is_the_sum_of_squares():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 30, 200))[::-1]
    bins, offsets, gaps = packing.sum_of_squares(sizes, 30)
    state: list[int] = []
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def squares(gs):
            return sum(c * c for c in np.bincount([g for g in gs if g], minlength=31).tolist())
        fits = [squares(state[:k] + [g - s] + state[k + 1:]) for k, g in enumerate(state) if g >= s]
        if fits:
            assert b < len(state) and state[b] >= s
            assert squares(state[:b] + [state[b] - s] + state[b + 1:]) == min(fits)
        else:
            assert b == len(state)
            state.append(30)
        assert o == 30 - state[b]
        state[b] -= s
    assert state == gaps.tolist()


def test_packing_in_many_groups_loses_nothing_and_fills_sequences(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 1024, 3000)] + [1024, 2000, 0, None]
    df = spark.createDataFrame([(i, 0, s, "keep") for i, s in enumerate(sizes)], "doc_id long, piece int, length long, offset string")
    got = packing.pack(df, items_per_task=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
    filled = defaultdict(int)
    for r in got:
        if r.length:
            filled[r.sequence_id] += r.length
        else:
            assert r.sequence_id is None
    small = [v for v in filled.values() if v <= 1024]
    assert len(small) <= 1.03 * sum(small) / 1024 + 2
    empty = packing.packed_documents(frame(spark, []), BYTE_BPE)
    assert empty.count() == 0 and "sequence_id" in empty.columns


@pytest.mark.parametrize("same_id", [False, True])
def test_packing_groups_stay_bounded_where_lengths_fill_no_sequence(spark, same_id):
    rng = np.random.default_rng(6)
    sizes = [int(x) for x in rng.integers(520, 1008, 2000)]
    df = spark.createDataFrame([(7 if same_id else i, 0, s) for i, s in enumerate(sizes)], "doc_id long, piece int, length long")
    got = packing.pack(df, items_per_task=100).collect()
    # No two fit together: each has a sequence of its own.
    assert sorted(r.length for r in got) == sorted(sizes) and len({r.sequence_id for r in got}) == len(sizes)
    groups = defaultdict(int)
    for r in got:
        groups[r.sequence_id // 2 >> 30] += 1
    assert max(groups.values()) <= 300


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2 ** 64 - 1)), max_size=400), st.sampled_from([7, 64, 4096]))
def test_simple8b_round_trip(values, block):
    x = np.array(values, np.uint64)
    words, first = token_files.encode(x, block)
    assert np.array_equal(token_files.decode(words, first, len(x), block), x)
    for k in range(len(first)):
        assert np.array_equal(token_files.decode_block(words, first, len(x), k, block), x[k * block:(k + 1) * block])
    assert len(words) <= 2 * len(x)


def test_token_files(spark, tmp_path):
    texts = awkward_texts()
    ids = [9, 3, 3, 7, 1, 2, 4, 5, 6, 8, 10, 11, 12]
    got = token_files.token_files(frame(spark, texts, ids), BYTE_BPE, str(tmp_path / "f"), segment_ids=500).collect()
    start = 0
    for doc, text in sorted(zip(ids, texts), key=lambda x: (x[0], x[1] is not None, x[1])):
        r = next(r for r in got if r.start == start)
        want = ids_of(text) + [0]
        assert (r.doc_id, r.n_tokens, bytes(r.ids)) == (doc, len(want), np.array(want, "<u4").tobytes())
        start += len(want)
    assert len(got) == len(texts)
    assert token_files.token_files(frame(spark, []), BYTE_BPE).count() == 0


def test_truncated_files_are_noticed():
    words, first = token_files.encode(np.arange(9000))
    with pytest.raises(ValueError):
        token_files.decode(words, first + 1, 9000)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_prefix_counts_are_the_librarys(text):
    changes, _ = prefix_counts.change_store(BYTE_BPE).of_texts(pa.array([text], pa.string()), chunks.byte_bpe_cuts)
    want = [len(ids_of(text[:i])) for i in range(len(text) + 1)]
    assert np.concatenate([[0], np.cumsum(changes, dtype=int)]).tolist() == want


def test_prefix_count_answers(spark):
    texts = awkward_texts()
    table = prefix_counts.prefix_counts(frame(spark, texts), BYTE_BPE, carry=("lang",))
    got = {r.doc_id: r for r in prefix_counts.answer_budgets(table, 20).collect()}
    at = {r.doc_id: r.tokens_at for r in prefix_counts.count_at(table, "n_chars").collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert (got[i].n_bytes, got[i].n_chars, got[i].n_tokens) == (len(t.encode()), len(t), len(ids_of(t)))
        assert at[i] == len(ids_of(t))
        if len(t) < 2000:
            assert got[i].chars_in_budget == max(k for k in range(len(t) + 1) if len(ids_of(t[:k])) <= 20)
    assert prefix_counts.prefix_counts(frame(spark, []), BYTE_BPE).count() == 0


def segmentations(m, text):
    edges, _ = m.lattice(text)
    def walk(at):
        if not at:
            yield 0.0, ()
            return
        for s, score, ids in edges[at]:
            for before, path in walk(s):
                yield before + score, path + ids
    return sorted(walk(len(text)), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["", "▁the", "▁▁▁x", "▁thorn", "日本\nab", "▁a\x00b"])
def test_nbest_equals_all_segmentations(text):
    m = nbest.model(PIECE_BPE)
    want = segmentations(m, text)
    for n in (1, 2, 3, 8):
        got = m.nbest(text, n)
        assert [s for s, _ in got] == [s for s, _ in want[:n]]
        assert len({ids for _, ids in got}) == len(got) and all((s, ids) in want for s, ids in got)


def test_nbest_of_texts_and_decoding(spark):
    m = nbest.model(PIECE_BPE)
    texts = awkward_texts() + ["the cat", "a b  c", "x\ny"]
    coded = nbest.encode_nbest(frame(spark, texts), PIECE_BPE, n=3).cache()
    got = defaultdict(dict)
    for r in coded.collect():
        got[r.doc_id][r["rank"]] = r
    for i, t in enumerate(texts):
        if t is not None and 0 < len(t) < 12:
            want = segmentations(m, "▁" + t.replace(" ", "▁"))[:3]
            assert [got[i][k].score for k in sorted(got[i])] == [s for s, _ in want]
        assert sorted(got[i]) == list(range(1, len(got[i]) + 1)) and len(got[i]) >= 1
    for r in nbest.decode(coded, PIECE_BPE).collect():
        assert r.decoded == (texts[r.doc_id] or "").replace("▁", " ")
    assert nbest.encode_nbest(frame(spark, []), PIECE_BPE).count() == 0


def test_document_combinations():
    rng = np.random.default_rng(0)
    for _ in range(50):
        losses = np.sort(rng.integers(0, 9, (4, 3)).astype(float), axis=1)
        losses[:, 0] = 0
        want = sorted(sum(c) for c in itertools.product(*losses))[:3]
        assert [x for x, _ in nbest._combinations(losses, 3)] == want


def test_a_full_store_keeps_the_chunks_it_meets_often(monkeypatch):
    searched = []
    plain = nbest.PieceModel.nbest
    monkeypatch.setattr(nbest.PieceModel, "nbest", lambda self, text, n: searched.append(text) or plain(self, text, n))
    often, small, large = [b"the", b" and", b" of"], nbest._Choices(PIECE_BPE, 2, limit=20), nbest._Choices(PIECE_BPE, 2)
    for k in range(12):
        words = often + [f" w{k}x{j}".encode() for j in range(9)]
        got = []
        for store in (small, large):
            slots, first, losses = store.slots(words)
            values, ends = store.store.gather(slots.ravel())
            got.append((values.tolist(), ends.tolist(), first.tolist(), losses.tolist()))
        assert got[0] == got[1]
    assert len(small.number) <= 20 + 12  # checked before a slice's chunks are added
    assert sum(t == "the" for t in searched) == 2  # once in each store
