"""Two-way comparison of file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.versions import same_second

VERSION = ("id", "size", "updated", "chunks")


def version() -> Column:
    return F.struct(*VERSION)


def last_per_path(files: DataFrame) -> DataFrame:
    """One row a path: of repeated paths the last in list order stands."""
    w = Window.partitionBy("path").orderBy(F.desc("ordinal"))
    return files.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def as_of(log: DataFrame, seen: Column | None = None) -> DataFrame:
    """The live file list that a change log (path, ts, event_id, live, and a version's columns) gives, of the rows `seen`."""
    rows = log if seen is None else log.where(seen)
    newest = rows.groupBy("path").agg(F.max_by(F.struct("live", *VERSION), F.struct("ts", "event_id")).alias("v"))
    return newest.where("v.live").select("path", *(F.col(f"v.{c}").alias(c) for c in VERSION))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, l, r: both versions of every path, one shuffle of each side."""
    a, b = left.select("path", version().alias("l")), right.select("path", version().alias("r"))
    return a.join(b, "path", "full_outer")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, l, r, change_kind: add (left only), remove (right only), update (another second), same."""
    l, r = F.col("l"), F.col("r")
    kind = F.when(r.isNull(), "add").when(l.isNull(), "remove").when(~same_second(l, r), "update").otherwise("same")
    return paired(left, right).withColumn("change_kind", kind)


def snapshot_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """The added and updated files of the left, and the removed ones of the right, with both versions of updates."""
    return compared(left, right).where("change_kind <> 'same'")


def upserts_and_removes(left: DataFrame, right: DataFrame) -> DataFrame:
    """What turns the right list into the left: path, action, v."""
    d = compared(left, right)
    return d.where("change_kind <> 'same'").select("path", F.when(F.col("change_kind") == "remove", "remove").otherwise("upsert").alias("action"), F.coalesce("l", "r").alias("v"))
