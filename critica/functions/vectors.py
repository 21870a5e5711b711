"""Array-of-double vector expressions (dense vectors as ``array<double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda s, v: s + v))


def l2_normalize(a) -> Column:
    """Unit-length copy; a zero vector gives null."""
    # The length is an element of an array, so that it is taken once a vector and not once a component.
    unit = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(_c(a), lambda x: x / n)))
    return F.element_at(unit, 1)


def cosine(a, b) -> Column:
    """Cosine similarity; null when either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda s, v: s + v)


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def sigmoid(z) -> Column:
    """Logistic function of a linear score."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def pad_truncate(ids, n: int):
    """Fixed-length ``input_ids`` and ``attention_mask`` from token ids."""
    ids = _c(ids)
    cut = F.slice(ids, 1, n)
    pad = F.greatest(F.lit(n) - F.size(cut), F.lit(0))
    input_ids = F.concat(cut, F.array_repeat(F.lit(0), pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(cut)), F.array_repeat(F.lit(0), pad))
    return input_ids, mask
