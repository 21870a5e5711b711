"""Cutting texts into chunks that a tokenizer treats independently.

Texts repeat their words.  A text is cut only where no token and no
pre-token can span the cut, so the ids of the whole text are the ids of
its chunks one after another.  Each distinct chunk is encoded once per
worker process and looked up afterwards; the store is bounded and starts
afresh when it is full, which changes time and never results.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together inside a task.
SLICE_BYTES = 8 << 20
#: Distinct chunks that a worker process remembers.
STORE_CHUNKS = 600_000


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return buf[first:int(offsets[-1])], offsets - first


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES):
    """Consecutive slices of a batch of at most ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    _, offsets = raw_bytes(batch.column(text_col))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = _table(b" \t\n\v\f\r")
_WORD = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
# '<', '|' and '>' are left out: the special string <|endoftext|> must stay in one chunk.
_MARK = _table(b".,;:!?)\"$%&*#")
_PLAIN = _WORD | _table(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def byte_bpe_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cut positions for a byte-level BPE whose pre-tokens are
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    Cut before white space that follows a character which is surely not white
    space (a pre-token has white space at its start only), and before a mark
    that follows a letter or digit (no pre-token has both in this order).
    """
    n = len(buf)
    flag = np.zeros(n + 1, bool)
    if n > 1:
        prev, here = buf[:-1], buf[1:]
        solid = _PLAIN[prev]
        # Two-byte characters from U+00C0 on are not white space; longer ones may be and are not cut after.
        solid[1:] |= (prev[1:] >= 0x80) & (prev[:-1] >= 0xC3) & (prev[:-1] < 0xE0)
        flag[1:n] = (_SPACE[here] & solid) | (_MARK[here] & _WORD[prev])
    flag[offsets] = True
    return np.flatnonzero(flag)


def distinct_chunks(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(index of each chunk among the distinct ones, the distinct chunks)."""
    if len(cuts) < 2:
        return np.zeros(0, np.int64), []
    arr = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1,
                                [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
    enc = arr.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False), enc.dictionary.to_pylist()


class ChunkStore:
    """Integer arrays by chunk, computed once per distinct chunk."""

    def __init__(self, compute, dtype, limit: int = STORE_CHUNKS):
        self.compute, self.dtype, self.limit = compute, dtype, limit
        self._clear()

    def _clear(self):
        self.slot: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, self.dtype)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def slots(self, words: list[bytes]) -> np.ndarray:
        if len(self.slot) > self.limit:
            self._clear()
        get = self.slot.get
        new = [w for w in words if get(w) is None]
        if new:
            self._add(new)
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def _add(self, new: list[bytes]):
        base = len(self.slot)
        self.append(self.compute(new), base)
        self.slot.update(zip(new, range(base, base + len(new))))

    def append(self, values, base: int):
        """Arrays for the slots from ``base`` on."""
        lens = np.fromiter(map(len, values), np.int64, len(values))
        self.extend(np.fromiter((x for v in values for x in v), self.dtype, int(lens.sum())), lens, base)

    def extend(self, flat: np.ndarray, lens: np.ndarray, base: int):
        """Arrays for the slots from ``base`` on, one after another."""
        total = len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(lens) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used:self.used + total] = flat
        self.start[base:base + len(lens)] = self.used + np.cumsum(lens) - lens
        self.length[base:base + len(lens)] = lens
        self.used += total

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the slots' arrays one after another, the end of each)."""
        lens = self.length[slots]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[slots] - (ends - lens), lens)
        at += np.arange(total)
        return self.flat[at], ends

    def of_texts(self, texts: pa.Array, cutter) -> tuple[np.ndarray, np.ndarray]:
        """(values of all texts one after another, offsets by text)."""
        buf, offsets = raw_bytes(texts)
        cuts = cutter(buf, offsets)
        index, words = distinct_chunks(buf, cuts)
        values, ends = self.gather(self.slots(words)[index] if words else np.zeros(0, np.int64))
        return values, np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The tokenizer of the file, as the library loads it (one thread; Spark runs the tasks side by side)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class IdStore(ChunkStore):
    """Ids by chunk of a byte-level BPE file.

    New chunks that start with white space and end in a character after
    which texts are cut are encoded as one text: the library's work per
    call is far more than that per chunk.  The ids are dealt out by their
    tokens' bytes, and only if every chunk ends where a token does.
    """

    #: Bytes of chunks that are encoded as one text.
    JOINED = 1 << 15

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        added = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = added.get(i, len(token))  # a character of a token stands for one byte
        super().__init__(self._each, np.uint32)

    def _each(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _add(self, new: list[bytes]):
        buf = np.frombuffer(b"".join(new), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        starts = np.concatenate([[0], ends[:-1]])
        last, before = buf[ends - 1], buf[np.maximum(ends - 2, starts)]
        solid = _PLAIN[last] | ((last >= 0x80) & (before >= 0xC3) & (before < 0xE0) & (ends - starts > 1))
        joined = _SPACE[buf[starts]] & solid
        together = [w for w, j in zip(new, joined.tolist()) if j]
        rest = [w for w, j in zip(new, joined.tolist()) if not j]
        if together and not self._together(together, (ends - starts)[joined]):
            rest = together + rest
        if rest:
            super()._add(rest)

    def _together(self, words: list[bytes], sizes: np.ndarray) -> bool:
        """Store the ids of ``words``, unless one of them does not end where a token does."""
        ends = np.cumsum(sizes)
        cuts = np.flatnonzero(np.diff(ends // self.JOINED)) + 1
        texts = [b"".join(words[a:b]).decode() for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)])]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        at = np.cumsum(self.bytes[ids])
        last = np.searchsorted(at, ends)
        if not len(at) or at[-1] != ends[-1] or (at[np.minimum(last, len(at) - 1)] != ends).any():
            return False
        base = len(self.slot)
        self.extend(ids, np.diff(np.concatenate([[0], last + 1])), base)
        self.slot.update(zip(words, range(base, base + len(words))))
        return True


@functools.lru_cache(maxsize=4)
def id_store(path: str) -> ChunkStore:
    """Ids by chunk of a byte-level BPE file, kept for the life of the worker process."""
    return IdStore(library_tokenizer(path))


def encode_ids(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(uint32 ids, offsets by text) of whole texts; ``end_id`` is appended to each."""
    ids, offsets = id_store(path).of_texts(texts, byte_bpe_cuts)
    if end_id is None:
        return ids, offsets
    out = np.full(len(ids) + len(texts), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    ends = offsets[1:] + np.arange(len(texts))
    keep[ends] = False
    out[keep] = ids
    return out, offsets + np.arange(len(texts) + 1)


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of a numeric array as a binary column (little-endian)."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer((np.asarray(offsets, np.int64) * size)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

