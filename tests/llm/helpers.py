"""Small tables with the awkward cases that every operator must take."""
from __future__ import annotations

import random

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, piece string, rank string, kept string, n_words string, start string"


def words(n: int, seed: int, alphabet: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(texts, ids=None):
    ids = ids or range(len(texts))
    return [(i, t, None, "x", None, "y", None, "z") for i, t in zip(ids, texts)]


def awkward_texts() -> list:
    base = words(120, 1)
    return [None, "", "   \n\t ", "one", base, base, base.replace(" ", "  "), base + " tail", words(9000, 2),
            "it's they're 'll  <|endoftext|> x\n\n  y   ", "日本語 テキスト ÀÉ ß \u00a0 ▁ 🎉", words(60, 3) + "\n" + words(60, 4),
            "aaaa" * 3000]


def frame(spark, texts, ids=None):
    return spark.createDataFrame(rows(texts, ids), SCHEMA)
