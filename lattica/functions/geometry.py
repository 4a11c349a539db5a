"""Vector columns: lengths, products and angles. A vector is a triple of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(a: str, b: str) -> Vector:
    """From columns ax, ay, az to bx, by, bz."""
    return tuple(F.col(f"{b}{k}") - F.col(f"{a}{k}") for k in "xyz")


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def distance(a: str, b: str, dims: str = "xyz") -> Column:
    """sqrt of the summed squares of the differences of columns a + dim and b + dim."""
    return length(*[F.col(f"{a}{k}") - F.col(f"{b}{k}") for k in dims])


def arccos(c: Column) -> Column:
    """Degrees; the argument is clamped to [-1, 1], null stays null."""
    return F.when(c.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))))


def dihedral_angle(i: str, j: str, k: str, m: str) -> Column:
    """Signed degrees between the planes ijk and jkm; null where three atoms lie on a line."""
    b1, b2, b3 = vector(j, i), vector(j, k), vector(m, k)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    angle = arccos(F.try_divide(dot(n1, n2), length(*n1) * length(*n2)))
    return angle * F.when(dot(b1, n2) < 0, -1.0).otherwise(1.0)
