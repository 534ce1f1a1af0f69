"""Column functions on vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def literal(values) -> Column:
    """A query vector as one constant."""
    return F.array(*[F.lit(float(x)) for x in values])


def hashed_embedding(tokens: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedder: signed counts of hashed tokens. Each token is hashed once; its code (place and
    sign) is sorted among even marks, so that the distances of neighbouring marks are the counts: n log n in the tokens."""
    minus = lambda t: F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2))
    codes = F.transform(tokens, lambda t: 4 * F.pmod(F.xxhash64(t), F.lit(dims)) + 2 * minus(t) + 1)
    marked = F.sort_array(F.concat(codes, F.transform(F.sequence(F.lit(0), F.lit(2 * dims)), lambda j: 2 * j.cast("long"))))
    marks = F.filter(F.transform(marked, lambda c, i: F.when(c % 2 == 0, i)), lambda i: i.isNotNull())
    count = lambda p, d: (2 * p[2 * d + 1] - p[2 * d] - p[2 * d + 2]).cast("double")
    # An array of one holds the marks, as what a lambda refers to is evaluated anew for each element.
    return F.transform(F.array(marks), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: count(p, d)))[0]
