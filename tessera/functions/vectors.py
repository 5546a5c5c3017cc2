"""Vectors: int8 quantisation, similarity, set overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def scale(v: Column) -> Column:
    """max/127, 1 for a zero vector (unrounded: what quantising divides by)."""
    m = max_abs(v)
    return F.when(m == 0, F.lit(1.0)).otherwise(m / 127)


def stored_scale(v: Column) -> Column:
    """The scale to eight significant digits."""
    s = scale(v)
    places = 7 - F.floor(F.log10(s))
    unit = F.pow(F.lit(10.0), places)
    return F.floor(s * unit + 0.5) / unit


def quantized(v: Column) -> Column:
    """Whole numbers from -127 to 127, halves rounded up."""
    s = scale(v)
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / s + 0.5).cast("int"))).cast("tinyint"))


def dequantized(q: Column, s: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * s)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(query: Column, item: Column) -> Column:
    """The query counts as normalised: only the item's norm divides; 0 for a zero item."""
    n = norm(item)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(query, item) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def hint(cosine_: Column, concepts: Column, title: Column) -> Column:
    """duplicate, related or novel, from the best match's signals (a null cosine counts as none)."""
    c = F.coalesce(cosine_, F.lit(-1.0))
    return F.when((c >= 0.92) | ((title >= 0.9) & (concepts >= 0.5)), "duplicate").when((c >= 0.86) | (concepts >= 0.5), "related").otherwise("novel")
