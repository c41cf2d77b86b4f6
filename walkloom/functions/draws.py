"""Draws that depend only on their keys: the same for any partitioning, and after any retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | int | str) -> Column:
    """md5 of the parts joined by '|'; also the sort key of a keyed shuffle."""
    return F.md5(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def u32(*parts: Column | int | str) -> Column:
    """Uniform whole number in [0, 2**32)."""
    return F.conv(F.substring(key(*parts), 1, 8), 16, 10).cast("long")


def pick(size: Column, *parts: Column | int | str) -> Column:
    """Uniform place in [0, size); 0 for an empty list."""
    return F.pmod(u32(*parts), F.greatest(size.cast("long"), F.lit(1).cast("long"))).cast("int")
