"""Angles, dihedrals and their bases as column expressions over structs (x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
Vector = tuple[Column, Column, Column]


def minus(a: Column, b: Column) -> Vector:
    return tuple(a[k] - b[k] for k in "xyz")


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def bond_angle(p0: Column, p1: Column, p2: Column) -> Column:
    """Angle at p1; coincident points give pi / 2."""
    a, b = minus(p0, p1), minus(p2, p1)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / (norm(a) * norm(b) + EPS))))


def dihedral(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """Signed angle between the planes; 0 where the middle bond has no length."""
    b1, b2, b3 = minus(p1, p0), minus(p2, p1), minus(p3, p2)
    n1, n2, size = cross(b1, b2), cross(b2, b3), norm(b2)
    unit = tuple(x / F.greatest(size, F.lit(EPS)) for x in b2)
    return F.when(size < EPS, F.lit(0.0)).otherwise(F.atan2(dot(cross(n1, unit), n2), dot(n1, n2)))


def angle_basis(angle: Column, k: int = 8) -> Column:
    """cos(l * angle) for l = 1..k."""
    return F.array(*[F.cos(angle * i) for i in range(1, k + 1)])


def dihedral_basis(angle: Column, k: int = 4) -> Column:
    """All sines, then all cosines."""
    return F.array(*[F.sin(angle * i) for i in range(1, k + 1)], *[F.cos(angle * i) for i in range(1, k + 1)])


def rbf(d: Column, k: int = 16, cutoff: float = 5.0, width: float | None = None) -> Column:
    """Gaussians around k centres from 0 to cutoff."""
    w = width or cutoff / k
    return F.array(*[F.exp(-((d - cutoff * i / (k - 1)) ** 2) / (2 * w * w)) for i in range(k)])
