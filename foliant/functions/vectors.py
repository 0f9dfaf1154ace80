"""Vector arithmetic on array columns; JVM-side higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import col


def doubles(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products over the shorter of the two vectors."""
    a, b = doubles(a), doubles(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    """Euclidean length; 1 for a zero vector, so that it can divide."""
    n = F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity with full-length norms; 0 for zero vectors."""
    return dot(a, b) / (norm(a) * norm(b))


def normalized(v: Column | str) -> Column:
    """Unit vector in single precision; a zero vector stays."""
    n = norm(v)
    return F.transform(col(v), lambda x: (x.cast("double") / n).cast("float"))


def all_zero(v: Column | str) -> Column:
    return ~F.exists(col(v), lambda x: F.abs(x) > 0)


def largest_divisor(value: Column | str, limit: Column | str) -> Column:
    """The largest divisor of ``value`` that is at most ``limit``; null for non-positive input."""
    v, top = col(value), F.least(col(value), col(limit))
    return F.when(top >= 1, F.array_max(F.filter(F.sequence(F.lit(1).cast("bigint"), top.cast("bigint")), lambda d: v % d == 0)))


def quantization_advice(rows: Column | str) -> Column:
    """Advice by collection size: none, sq (8 bit) or pq."""
    n = col(rows)
    return F.when(n < 1_000, "none").when(n < 100_000, "sq").otherwise("pq")


def product_quantization(rows: Column | str, dim: Column | str, most: int = 16) -> Column:
    """Advice with its settings: (kind, bits, m): no quantisation, 8-bit scalars, or products of ``m`` parts that divide the dimension."""
    kind = quantization_advice(rows)
    bits = F.when(kind != "none", F.lit(8))
    return F.struct(kind.alias("kind"), bits.alias("bits"), F.when(kind == "pq", largest_divisor(dim, F.lit(most).cast("bigint"))).alias("m"))


def encoded(v: Column | str) -> Column:
    """A vector as JSON."""
    return F.to_json(col(v))


def decoded(c: Column | str) -> Column:
    """A vector from JSON; null where it is none."""
    return F.from_json(col(c), "array<double>")
