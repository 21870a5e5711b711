"""Operator 7: SentencePiece N-best encoding, and decoding.

The pieces of a SentencePiece model and their scores form a lattice over a
text.  A forward Viterbi pass stores the best score of every prefix.  A
backward A-star search from the end uses these scores as its heuristic;
as they are exact, segmentations leave the queue best first, and the
first N of them are the N best.

A text's lattice falls apart where no piece spans a place: before white
space, and between characters that no piece has side by side.  The search
runs once per distinct chunk; a document's N best are the best
combinations of its chunks' N best, for which only the N - 1 chunks with
the smallest loss to their second choice can matter.

Characters without a piece become the model's byte pieces, with the score
of the worst piece less 10 for each character.  A model without all byte
pieces gives its unknown id for them.  The text gets the usual leading
space; white space is coded as U+2581, so a U+2581 in a text decodes as a
space, as in the library.  With a model of type BPE the piece scores are
its merge ranks: the result is the best-scored segmentation of the
lattice, which can differ from that by merging.

Defined results.  Null and empty texts have one segmentation without
pieces and score 0.  A text with fewer than N segmentations gives fewer
rows.  Equal scores come in the order in which the search meets them,
the same each time.  Repeated rows and ids are coded row by row; other
columns are carried only where named in ``carry``.  An empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import functools
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.llm import chunks as C

SPACE = "▁"
#: Bytes of text or of ids that are worked on together.
SLICE_BYTES = 1 << 20
#: Distinct chunks that a worker process remembers.
CHUNKS = 300_000


def _tree(pieces: dict) -> dict:
    """(branches, score, ids) by character from the first one on; the score is None where no piece ends."""
    tops, none = {}, {}
    for piece, (score, ids) in sorted(pieces.items()):
        branch = tops
        for k, char in enumerate(piece, 1):
            found = branch.get(char) or (none, None, ())
            if k == len(piece):
                found = (found[0], score, ids)
            elif found[0] is none:
                found = ({}, *found[1:])
            branch[char] = found
            branch = found[0]
    return tops


class PieceModel:
    """Pieces, scores and cuts of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i), (i,)) for i in normal}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.tree = _tree({p: found[1:] for p, found in self.pieces.items()})
        self.unknown_score = min(s for _, s, _ in self.pieces.values()) - 10
        #: What each id stands for in decoded text.
        self.spelling = [b""] * n
        for p, (i, _, _) in self.pieces.items():
            self.spelling[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.spelling[i] = bytes([b])
        self.spelling[self.unknown] = " ⁇ ".encode()
        self.spell_bytes = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.spell_len = np.array([len(s) for s in self.spelling], np.int64)
        self.spell_start = np.cumsum(self.spell_len) - self.spell_len
        # joined[a, b]: some piece has the ASCII characters a and b side by side.
        self.joined = np.zeros((128, 128), bool)
        inner_space = False
        for p in self.pieces:
            t = p.replace(SPACE, " ")
            inner_space |= " " in t.strip(" ") or t != t.rstrip(" ") and t.strip(" ") != ""
            for a, b in zip(t, t[1:]):
                if a < "\x80" and b < "\x80":
                    self.joined[ord(a), ord(b)] = True
        self.cut_before_space = not inner_space
        self.ascii = np.zeros(256, bool)
        self.ascii[:128] = True

    def cuts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places that no piece spans (a U+0020 stands for U+2581)."""
        flag = np.zeros(len(buf) + 1, bool)
        if len(buf) > 1:
            a, b = buf[:-1], buf[1:]
            both = self.ascii[a] & self.ascii[b]
            flag[1:-1] = both & ~self.joined[a & 127, b & 127]
            if self.cut_before_space:
                # A last byte 0x81 may end a literal U+2581, which is a space too.
                flag[1:-1] |= (b == 32) & (a != 32) & (a != 0x81)
        flag[offsets] = True
        return np.flatnonzero(flag)

    def lattice(self, text: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """(edges, best): by end position, (start, score, ids) of every piece, and the best score of the prefix."""
        tree, size = self.tree, len(text)
        edges, best = [[] for _ in range(size + 1)], [0.0] + [-np.inf] * size
        for start in range(size):
            done, branch, end = best[start], tree, start
            for char in text[start:]:
                end += 1
                found = branch.get(char)
                if found is None:  # no piece begins so
                    score = None
                else:
                    branch, score, ids = found
                    if score is not None:
                        edges[end].append((start, score, ids))
                        total = done + score
                        if total > best[end]:
                            best[end] = total
                if score is None and end == start + 1:  # the character alone is no piece
                    ids = tuple(self.bytes.get(x, self.unknown) for x in char.encode())
                    edges[end].append((start, self.unknown_score, ids if self.unknown not in ids else (self.unknown,)))
                    best[end] = max(best[end], done + self.unknown_score)
                if found is None:
                    break
        return edges, best

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), best first.

        An entry of the queue stands for all segmentations with its last
        pieces, and its key is the exact score of the best of them.  The
        entries' segmentations are disjoint, so no more entries than
        segmentations are still wanted can ever be needed.
        """
        edges, best = self.lattice(text)
        found, met = [], 0
        queue = [(-best[-1], 0, len(text), 0.0, ())]
        while queue and len(found) < n:
            _, _, at, done, path = queue.pop(0)
            if not at:
                ids = []
                while path:
                    piece, path = path
                    ids.extend(piece)
                found.append((done, tuple(ids)))
                continue
            wanted = n - len(found)
            for s, score, piece in edges[at]:
                met -= 1  # the latest first: among equal scores the search goes on with the path that it follows
                key = -(best[s] + score + done)
                if len(queue) >= wanted:
                    if key > queue[-1][0]:
                        continue
                    queue.pop()
                bisect.insort(queue, (key, met, s, done + score, (piece, path)))
        return found


@functools.lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


class _Choices:
    """N best by distinct chunk: slots of ids, and the scores of the choices.

    One dictionary entry per chunk; its n choices stand at n * number in the arrays.
    A full store keeps the chunks that it met most often (half of its limit at most).
    """

    def __init__(self, path: str, n: int, limit: int = CHUNKS):
        self.model, self.n, self.limit = model(path), n, limit
        self._clear()

    def _clear(self):
        self.number: dict[bytes, int] = {}
        self.store = C.ChunkStore(None, np.int32)
        self.scores = np.full((1 << 12, self.n), -np.inf)
        self.met = np.zeros(0, np.int64)

    def _keep_known(self):
        """Forget the chunks met once, or the least met ones; half of the others' counts is kept."""
        met, n = self.met, self.n
        kept = np.sort(np.argsort(-met, kind="stable")[:self.limit // 2])
        kept = kept[met[kept] > 1]
        words, scores = list(self.number), self.scores[kept]
        slots = (kept[:, None] * n + np.arange(n)).ravel()
        flat, ends = self.store.gather(slots)
        self._clear()
        self.number = {words[k]: i for i, k in enumerate(kept.tolist())}
        self.store.extend(flat, np.diff(ends, prepend=0), 0)
        self.scores, self.met = np.concatenate([scores, self.scores]), met[kept] // 2

    def slots(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots, scores of the first choice, losses) by word and choice; a missing choice loses infinity."""
        if len(self.number) > self.limit:
            self._keep_known()
        n, base, new = self.n, len(self.number), [w for w in words if w not in self.number]
        values = []
        for k, w in enumerate(new, base):
            found = self.model.nbest(w.decode().replace(" ", SPACE), n)
            while k >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.full_like(self.scores, -np.inf)])
            self.scores[k, :len(found)] = [s for s, _ in found]
            values.extend(found[c][1] if c < len(found) else () for c in range(n))
            self.number[w] = k
        self.store.append(values, base * n)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[at] += 1
        scores = self.scores[at]
        return at[:, None] * n + np.arange(n), scores[:, 0], scores[:, :1] - scores


@functools.lru_cache(maxsize=2)
def _choices(path: str, n: int) -> _Choices:
    return _Choices(path, n)


def _combinations(losses: np.ndarray, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n smallest total losses over chunks, as (loss, ((chunk, choice), ...)).

    ``losses``: one row per chunk, ascending from 0.
    """
    out = [(0.0, ())]
    if n == 1 or not len(losses):
        return out
    second = losses[:, 1]
    near = np.argsort(second, kind="stable")[:n - 1] if len(second) <= 4 * n else \
        np.sort(np.argpartition(second, n - 2)[:n - 1])
    for c in near.tolist():
        more = [(loss + losses[c, k], how + ((c, k),)) for loss, how in out for k in range(1, n)
                if np.isfinite(losses[c, k])]
        out = heapq.nsmallest(n, out + more, key=lambda x: x[0])
    return out


def encode_nbest(docs: DataFrame, model_path: str, n: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, rank, score, n_pieces, ids): the n best segmentations of every whole text.

    ``ids`` holds little-endian unsigned 32-bit integers.
    """
    names = [id_col, *(c for c in carry if c != id_col)]
    src = docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*src.schema.fields[:-1]] + [
        T.StructField(c, t) for c, t in (("rank", T.IntegerType()), ("score", T.DoubleType()),
                                         ("n_pieces", T.LongType()), ("ids", T.BinaryType()))])

    def code(batches):
        choices = _choices(model_path, n)
        for batch in batches:
            for part in C.slices(batch, "_text", SLICE_BYTES):
                texts = part.column(len(names)).cast(pa.large_string()).fill_null("")
                spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts,
                                    pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
                buf, offsets = C.raw_bytes(spaced)
                cuts = choices.model.cuts(buf, offsets)
                index, words = C.distinct_chunks(buf, cuts)
                slots, first, losses = choices.slots(words) if words else (np.zeros((0, n), np.int64),) + (np.zeros((0, n)),) * 2
                bounds = np.searchsorted(cuts, offsets)
                total = np.concatenate([[0.0], np.cumsum(first[index] if words else [])])
                rows, ranks, scores, chosen, sizes = [], [], [], [], []
                for d in range(len(part)):
                    a, b = bounds[d], bounds[d + 1]
                    own = index[a:b]
                    score = float(total[b] - total[a])
                    for rank, (loss, how) in enumerate(_combinations(losses[own], n), 1):
                        use = slots[own, 0]
                        for c, k in how:
                            use[c] = slots[own[c], k]
                        rows.append(d)
                        ranks.append(rank)
                        scores.append(score - loss)
                        chosen.append(use)
                        sizes.append(len(use))
                values, ends = choices.store.gather(np.concatenate(chosen) if chosen else np.zeros(0, np.int64))
                offs = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(i).take(pa.array(rows, pa.int64())) for i in range(len(names))),
                    pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()), pa.array(np.diff(offs)),
                    C.binary_column(values.astype("<u4"), offs)], names=schema.names)

    return src.mapInArrow(code, schema)


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text that its ids stand for in place of the ids.

    Ids outside the model decode as nothing; bytes that form no UTF-8 become
    U+FFFD; null ids give null.
    """
    keep = [c for c in coded.columns if c not in (ids_col, out_col)]
    schema = T.StructType([coded.schema[c] for c in keep] + [T.StructField(out_col, T.StringType())])

    def read(batches):
        m = model(model_path)
        for batch in batches:
            # Slices bound the index of every byte of the text.
            for part in C.slices(batch, ids_col, SLICE_BYTES):
                column = part.column(len(keep))
                buf, offsets = C.raw_bytes(column)
                ids = np.frombuffer(buf.tobytes(), "<u4").astype(np.int64)
                ids[ids >= len(m.spell_len)] = -1
                lens = np.where(ids >= 0, m.spell_len[ids], 0)
                ends = np.cumsum(lens)
                at = np.repeat(m.spell_start[ids] - (ends - lens), lens) + np.arange(int(lens.sum()))
                bounds = np.concatenate([[0], ends])[offsets // 4]
                whole = m.spell_bytes[at].tobytes()
                nulls = column.is_null().to_pylist()
                out = [None if nulls[i] else whole[a:b].decode(errors="replace")
                       for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))),
                                                  pa.array([s[1:] if s and s[0] == " " else s for s in out], pa.string())],
                                                 names=schema.names)

    return coded.select(*keep, ids_col).mapInArrow(read, schema)
