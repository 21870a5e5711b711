"""Operator 5: exact token counts at every prefix, by dynamic programming.

For a byte-level BPE the encoding of a pre-token's prefix of i bytes ends
with one certain token t, and what stands before it is the encoding of
the shorter prefix without t.  A sequence of tokens is an encoding exactly
if each adjacent pair encodes to itself.  So

    count(i) = count(i - len(t)) + 1

for the one token t that ends at i and stands beside last(i - len(t)) in
an encoding of the two.  Pair tests are remembered.  One pass over a
pre-token yields the counts of all its prefixes, and a text's counts are
those of its chunks one after another.

``prefix_counts`` stores, per document, the change of the count at every
character as signed integers of ``width`` bytes.  ``answer_budgets`` reads
truncation and budget questions off that column without encoding again.

Exactness.  A prefix may be split into pre-tokens otherwise than the whole
text.  Two cases exist and are followed: a prefix that ends inside a run
of white space (the run's last character belongs to the next pre-token
only if more follows) and one that ends inside a contraction such as 're.
Added special strings are one token, as the library reads them; inside
one, the prefix is ordinary text.

Defined results.  Null text counts as empty: no bytes, no tokens, an empty
table.  Repeated rows and ids are answered row by row; other columns are
carried only where named in ``carry``.  An empty table gives an empty
result.  Whole texts are counted, however long; a task holds one slice of
texts at a time.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.llm import chunks as C

#: Contractions that are pre-tokens of their own and longer than two characters.
LONG_CONTRACTIONS = (b"'re", b"'ve", b"'ll")
#: Remembered pair tests per worker process.
PAIRS = 300_000


def byte_alphabet() -> dict[str, int]:
    """Byte by the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Prefix counts by chunk for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        self.vocabulary = {bytes(of[c] for c in t) for t in spec["model"]["vocab"] if all(c in of for c in t)}
        self.longest = max(map(len, self.vocabulary))
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {tuple(bytes(of[c] for c in side) for side in m): k for k, m in enumerate(merges)}
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.pieces = C.library_tokenizer(path).pre_tokenizer.pre_tokenize_str
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.single: dict[bytes, bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """The piece's tokens by merging in order of rank."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(p) for p in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, left: bytes, right: bytes) -> bool:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        ok = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return ok

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of a pre-token, by number of bytes (from 0)."""
        vocabulary, pairs, last, count = self.vocabulary, self.pairs, [b""], [0]
        size, longest = len(piece), self.longest
        for i in range(1, size + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = piece[j:i]
                if token not in vocabulary:
                    continue
                if j:
                    ok = pairs.get((last[j], token))
                    if ok is None:
                        ok = self._pair(last[j], token)
                else:
                    ok = self.single.get(token)
                    if ok is None:
                        ok = self.single[token] = self.merge(token) == [token]
                if ok:
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError(f"no token ends at byte {i} of {piece!r}")
        return count

    def plain_counts(self, text: bytes) -> list[int]:
        """Tokens of each byte prefix of a text without special strings (right at character ends)."""
        out, base, at = [0], 0, 0
        chars = text.decode()
        word = chars[1:] if chars[:1] == " " else chars
        if word.isalpha() and max(word) < "\u0250":
            return self.piece_counts(text)  # letters after at most one space are one pre-token
        sizes = [len(p) for p, _ in self.pieces(chars)]
        for k, size in enumerate(sizes):
            piece = text[at:at + size]
            counts = self.piece_counts(piece)
            if piece in LONG_CONTRACTIONS:
                counts[2] = self.piece_counts(piece[:1])[1] + self.piece_counts(piece[1:2])[1]
            done = len(out) - 1 - at  # bytes of this piece that the run before has told
            out.extend(base + c for c in counts[1 + done:])
            if k + 1 < len(sizes) and piece.decode().isspace():
                # White space whose last character opens the next piece is one run until more follows.
                end = at + size + len(text[at + size:at + size + 4].decode(errors="ignore")[:1].encode())
                if len(self.pieces(text[at:end].decode())) == 1:
                    run = self.piece_counts(text[at:end])
                    out[at + 1:] = [base + c for c in run[1:]]
            base += counts[size]
            at += size
        return out

    def chunk_changes(self, chunk: bytes) -> list[int]:
        """Change of the count at each character of a chunk."""
        counts, at = [0], 0
        while at < len(chunk):
            found = min(((chunk.find(s, at), -len(s), s) for s in self.special if s in chunk[at:]), default=None)
            end = found[0] if found else len(chunk)
            base = counts[-1]
            if not found:
                counts.extend(base + c for c in self.plain_counts(chunk[at:])[1:])
                break
            special = found[2]
            inside = self.plain_counts(chunk[at:end + len(special)])
            before = self.plain_counts(chunk[at:end])
            counts.extend(base + c for c in before[1:])
            counts.extend(base + c for c in inside[end - at + 1:-1])
            counts.append(base + before[-1] + 1)
            at = end + len(special)
        ends = [i for i in range(1, len(chunk) + 1) if i == len(chunk) or chunk[i] & 0xC0 != 0x80]
        values = [0] + [counts[i] for i in ends]
        return [b - a for a, b in zip(values, values[1:])]


@functools.lru_cache(maxsize=4)
def change_store(path: str) -> C.ChunkStore:
    counter = PrefixCounter(path)
    return C.ChunkStore(lambda words: [counter.chunk_changes(w) for w in words], np.int16)


def _packed(changes: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(binary column, width by row): one byte a character, two for rows with a change that needs them."""
    wide = np.abs(changes) > 127
    if not wide.any():
        return C.binary_column(changes.astype(np.int8), offsets), np.ones(len(offsets) - 1, np.int8)
    rows, widths = [], []
    for a, b in zip(offsets[:-1], offsets[1:]):
        widths.append(2 if wide[a:b].any() else 1)
        rows.append(changes[a:b].astype("<i2" if widths[-1] == 2 else np.int8).tobytes())
    return pa.array(rows, pa.binary()), np.array(widths, np.int8)


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, n_bytes, n_chars, n_tokens, width, changes) of every whole text."""
    names = [id_col, *(c for c in carry if c != id_col)]
    src = docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1]] + [
        T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_chars", T.LongType()), ("n_tokens", T.LongType()),
                                         ("width", T.ByteType()), ("changes", T.BinaryType()))])

    def count(batches):
        store = change_store(tokenizer_path)
        for batch in batches:
            for part in C.slices(batch, "_text"):
                _, byte_ends = C.raw_bytes(part.column(len(names)))
                changes, offsets = store.of_texts(part.column(len(names)), C.byte_bpe_cuts)
                running = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
                column, width = _packed(changes, offsets)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(i) for i in range(len(names))), pa.array(np.diff(byte_ends)), pa.array(np.diff(offsets)),
                    pa.array(running[offsets[1:]] - running[offsets[:-1]]), pa.array(width), column],
                    names=schema.names)

    return src.mapInArrow(count, schema)


def unpack(changes: bytes, width: int) -> np.ndarray:
    """Tokens of each prefix of 0, 1, 2, ... characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(changes, np.int8 if width == 1 else "<i2"), dtype=np.int64)])


def answer_budgets(prefixes: DataFrame, budget: int, out_col: str = "chars_in_budget") -> DataFrame:
    """``prefixes`` without its table, with the characters of the longest prefix of at most ``budget`` tokens.

    Counts may fall as a prefix grows, so the longest fitting prefix is the
    last position whose count is within the budget, not the first one over it.
    """
    keep = [c for c in prefixes.columns if c not in ("changes", "width", out_col)]
    schema = T.StructType([prefixes.schema[c] for c in keep] + [T.StructField(out_col, T.LongType())])

    def read(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            widths, changes = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1)
            for i in range(batch.num_rows):
                counts = unpack(changes[i].as_buffer(), widths[i])
                found[i] = len(counts) - 1 if counts[-1] <= budget else np.flatnonzero(counts <= budget)[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(found)],
                                             names=schema.names)

    return prefixes.select(*keep, "width", "changes").mapInArrow(read, schema)


def count_at(prefixes: DataFrame, position_col: str, out_col: str = "tokens_at") -> DataFrame:
    """``prefixes`` with the token count of each row's first ``position_col`` characters.

    A position beyond the text gives the whole count, a negative one 0, a null one null.
    """
    keep = [c for c in prefixes.columns if c not in ("changes", "width", out_col)]
    schema = T.StructType([prefixes.schema[c] for c in keep] + [T.StructField(out_col, T.LongType())])
    src = prefixes.select(*keep, F.col(position_col).cast("long").alias("_at"), "width", "changes")

    def read(batches):
        for batch in batches:
            out = []
            for at, width, changes in zip(*(batch.column(len(keep) + k).to_pylist() for k in range(3))):
                counts = unpack(changes, width)
                out.append(None if at is None else int(counts[min(max(at, 0), len(counts) - 1)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(out, pa.int64())],
                                             names=schema.names)

    return src.mapInArrow(read, schema)
