"""Words of whole text columns, found over byte buffers without a loop over texts or words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from critica.llm.chunks import raw_bytes

#: Byte classes of a table; neither byte is part of a word (0xFF never occurs in UTF-8).
SEPARATOR, BREAK = 0x20, 0xFF


def byte_classes(separators: bytes, breaks: bytes = b"") -> np.ndarray:
    """Table of 256: A-Z lower-cased, separators and breaks marked, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[list(separators)] = SEPARATOR
    table[list(breaks)] = BREAK
    return table


def split_words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row of each word, piece of each word) of a string column; null texts have no words.

    Words are maximal runs of bytes that the table does not mark.  Pieces
    end at breaks and at the end of a text; consecutive words of one piece
    have equal piece numbers.
    """
    buf, offsets = raw_bytes(texts)
    low = table[buf]
    is_word = (low != SEPARATOR) & (low != BREAK)
    # A word starts where the byte before is no word's, or at the start of a text.
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(low)]
    first[heads] = is_word[heads]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.flatnonzero(low == BREAK)
    # Both numbers never fall, so their sum stays the same only if both do.
    piece = np.searchsorted(breaks, starts) + row
    data = low[is_word]
    place = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        place[1:] = np.cumsum(np.add.reduceat(is_word, starts, dtype=np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(data)])
    return words, row, piece


def dictionary(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of each word, distinct words)."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
