"""Vector arithmetic as Column builders over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float], kind: str = "float") -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast(f"array<{kind}>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where a norm is not above 0 (a zero vector, or one with a NaN)."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    ok = (na > 0) & (nb > 0) & ~F.isnan(na) & ~F.isnan(nb)
    return F.when(ok, dot(a, b) / (na.cast("double") * nb.cast("double"))).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def euclidean_sq(a: Column, b: Column) -> Column:
    """Directly from differences: no cancellation."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean_sq_by_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.greatest(F.lit(0.0), norm_a * norm_a + norm_b * norm_b - 2 * dot(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(euclidean_sq(a, b))


def quantize(v: Column) -> Column:
    """struct(q8, scale): symmetric, scale = max|v| / 127 as float, halves away from zero; zero vectors give zeros."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    q = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x * (F.lit(127.0) / top).cast("float")).cast("int"))).cast("tinyint"))
    zero = F.transform(v, lambda x: F.lit(0).cast("tinyint"))
    return F.struct(F.when(top > 0, q).otherwise(zero).alias("q8"), F.when(top > 0, (top / F.lit(127.0)).cast("float")).otherwise(F.lit(0.0).cast("float")).alias("scale"))


def dequantize(q8: Column, scale: Column) -> Column:
    return F.transform(q8, lambda q: (q.cast("float") * scale).cast("float"))


def int8_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def int8_cosine(a: Column, scale_a: Column, norm_a: Column, b: Column, scale_b: Column, norm_b: Column) -> Column:
    """With the norms of the vectors as they were before quantization; not clamped."""
    ok = (norm_a > 0) & (norm_b > 0) & (scale_a > 0) & (scale_b > 0)
    return F.when(ok, int8_dot(a, b) * scale_a.cast("double") * scale_b.cast("double") / (norm_a.cast("double") * norm_b.cast("double"))).otherwise(0.0)


def int8_euclidean_sq(a: Column, scale_a: Column, norm_a: Column, b: Column, scale_b: Column, norm_b: Column) -> Column:
    na, nb = norm_a.cast("double"), norm_b.cast("double")
    return F.greatest(F.lit(0.0), na * na + nb * nb - 2 * int8_dot(a, b) * scale_a.cast("double") * scale_b.cast("double"))
