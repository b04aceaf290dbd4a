"""Vector arithmetic on arrays; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["cosine", "dot", "l1", "l2", "linf", "softmax", "wl_bucket"]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or all zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def softmax(a: Column) -> Column:
    """Shares of exp(x - max): no overflow."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / _sum(e))


def wl_bucket(label: Column, width: int = 2048) -> Column:
    """Bucket of a graph label: the first four bytes of its MD5, little-endian, modulo ``width``."""
    h = F.md5(label)
    turned = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return (F.conv(turned, 16, 10).cast("bigint") % width).cast("int")
