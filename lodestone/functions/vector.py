"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokenize import token_hash, tokens


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """A vector of length zero counts as of length one."""
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised(v: Column) -> Column:
    """A vector of length zero stays."""
    n = norm(v)
    both = F.struct(doubles(v).alias("v"), F.when(n == 0, 1.0).otherwise(n).alias("n"))
    return bound(both, lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def finite(v: Column) -> Column:
    """Neither null nor empty, and without NaN or infinities."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def without_nan(v: Column) -> Column:
    bad = lambda x: F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.transform(v, lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x.cast("double")))


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """A deterministic embedding without a model: each token adds one, with a
    sign, at the place that its hash names; the sum is scaled to length one.
    Where the signs cancel throughout, the tokens count without them, so only
    a text without tokens has the zero vector."""
    hashes = F.transform(tokens(text), token_hash)

    def total(sign) -> Column:
        def add(v: Column, h: Column) -> Column:
            return F.transform(v, lambda x, i: F.when(i == h % dimension, x + sign(h)).otherwise(x))

        return F.aggregate(hashes, F.array_repeat(F.lit(0.0), dimension), add)

    signed = total(lambda h: F.when(F.shiftright(h, 16) % 2 == 0, 1.0).otherwise(-1.0))
    return bound(F.when(F.exists(signed, lambda x: x != 0), signed).otherwise(total(lambda h: F.lit(1.0))), normalised)
