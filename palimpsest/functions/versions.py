"""Predicates between two versions of a file, as struct columns (id, size, updated, chunks); a null struct is no version.

All of them are total: a missing side gives true or false, never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import STALE_MS, whole_seconds


def same_second(a: Column, b: Column) -> Column:
    """Equal up to the whole second; two missing versions are not compared by this."""
    return F.coalesce(whole_seconds(a["updated"]) == whole_seconds(b["updated"]), F.lit(False))


def same_content(a: Column, b: Column) -> Column:
    """Equal size and equal chunks in order; two missing versions are equal, one is not."""
    both = a["size"].eqNullSafe(b["size"]) & a["chunks"].eqNullSafe(b["chunks"])
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def same_version(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(same_second(a, b) & same_content(a, b))


def stale(candidate: Column, other: Column) -> Column:
    """More than seven minutes older than the other."""
    return F.coalesce(candidate["updated"] < other["updated"] - STALE_MS, F.lit(False))


def prefers_cloud(local: Column, cloud: Column) -> Column:
    """Whose metadata stands for equal content: the later, then the larger id."""
    later = (cloud["updated"] > local["updated"]) | ((cloud["updated"] == local["updated"]) & (cloud["id"] > local["id"]))
    return F.when(cloud.isNull(), F.lit(False)).when(local.isNull(), F.lit(True)).otherwise(later)
