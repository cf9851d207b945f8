"""Column builders over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of length zero or of unequal size."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both).otherwise(0.0)


def rounded(x: Column, places: int = 6) -> Column:
    """A double to ``places`` places as databases round it: the product with the power of ten is rounded, halves away from zero.

    F.round looks at the decimal digits instead, so that 201 / 3200 = 0.0628125 goes up although its product is 62812.49999999999.
    """
    return F.round(x * 10.0**places) / 10.0**places


def pad(a: Column, size: int) -> Column:
    """A vector filled up with zeros, which leaves cosines as they are."""
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(size) - F.size(a))))


def hashed_vector(text: Column, size: int = 32) -> Column:
    """A deterministic stand-in for an embedding: character codes / 255 added up at their place modulo ``size``."""
    codes = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.when(c != "", F.ascii(c) / 255.0).otherwise(0.0))
    slot = lambda k: F.aggregate(F.filter(codes, lambda _, i: i % size == k), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[slot(k) for k in range(size)])
