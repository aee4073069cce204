"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def clip(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, high), low)


def norm(parts: list[Column]) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def _minus(p: list[Column], q: list[Column]) -> list[Column]:
    return [a - b for a, b in zip(p, q, strict=True)]


def _dot(p: list[Column], q: list[Column]) -> Column:
    out = p[0] * q[0]
    for a, b in zip(p[1:], q[1:], strict=True):
        out = out + a * b
    return out


def segment_distance(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Distance from ``p`` to the segment from ``a`` to ``b``; a segment of no length is a point."""
    along, to = _minus(b, a), _minus(p, a)
    length = _dot(along, along)
    t = F.when(length == 0, F.lit(0.0)).otherwise(clip(_dot(to, along) / F.nullif(length, F.lit(0.0)), F.lit(0.0), F.lit(1.0)))
    return norm([x - t * y for x, y in zip(to, along, strict=True)])


def triangle_distance(p: list[Column], a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Distance from ``p`` to the triangle abc in space: to its plane above the triangle, else to its nearest side."""
    ab, ac, to = _minus(b, a), _minus(c, a), _minus(p, a)
    sides = F.least(segment_distance(p, a, b), segment_distance(p, b, c), segment_distance(p, a, c))
    d00, d01, d11, d20, d21 = _dot(ab, ab), _dot(ab, ac), _dot(ac, ac), _dot(to, ab), _dot(to, ac)
    area = d00 * d11 - d01 * d01
    v, w = F.try_divide(d11 * d20 - d01 * d21, area), F.try_divide(d00 * d21 - d01 * d20, area)
    normal = [ab[1] * ac[2] - ab[2] * ac[1], ab[2] * ac[0] - ab[0] * ac[2], ab[0] * ac[1] - ab[1] * ac[0]]
    height = F.abs(F.try_divide(_dot(to, normal), norm(normal)))
    above = (v >= 0) & (w >= 0) & (v + w <= 1) & height.isNotNull()
    return F.when(F.coalesce(above, F.lit(False)), height).otherwise(sides)
