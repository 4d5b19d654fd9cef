"""Reachability, purge and integrity over refs -> snapshots -> files -> chunks. Depth is fixed, so no recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import valid_object_id


def valid_refs(refs: DataFrame) -> DataFrame:
    """Distinct snapshot ids of reference contents: trimmed, 40 characters, at most 42 bytes as stored."""
    return refs.where(F.octet_length("content") <= 42).select(F.trim("content").alias("snapshot_id")).where(F.length("snapshot_id") == 40).distinct()


def referenced(refs: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """Distinct referenced snapshot ids, and those the caller wants kept."""
    ids = refs.select("snapshot_id")
    return (ids if retained is None else ids.unionByName(retained.select("snapshot_id"))).distinct()


def unreferenced_snapshots(snapshots: DataFrame, kept: DataFrame) -> DataFrame:
    return snapshots.join(kept, "snapshot_id", "left_anti")


def in_kept(intervals: DataFrame, snapshots: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of `intervals` (first, next, ...) with a kept snapshot from `first` to before `next`; `snapshots` (snap, snapshot_id)
    are numbered from 1 without gaps.

    The kept ones up to each number are counted over the snapshots alone; an interval holds one if the counts at its two ends
    differ. So a version is one row, whatever the number of snapshots that it is in, and both joins are by equality.
    """
    flagged = snapshots.select("snap", "snapshot_id").join(kept.select("snapshot_id", F.lit(1).alias("one")).distinct(), "snapshot_id", "left")
    upto = flagged.select((F.col("snap") + 1).alias("at"), F.sum(F.coalesce("one", F.lit(0))).over(Window.orderBy("snap")).alias("n"))  # one row a snapshot
    ends = lambda c: upto.select(F.col("at").alias(c), F.col("n").alias(f"__{c}"))
    both = intervals.join(ends("first"), "first", "left").join(ends("next"), "next", "left")
    return both.where(F.coalesce("__next", F.lit(0)) > F.coalesce("__first", F.lit(0))).select(*intervals.columns)


def reachable(snapshot_files: DataFrame, kept: DataFrame) -> DataFrame:
    """object_id, kind: files and chunks that kept snapshots reach. Missing snapshots reach nothing."""
    return objects_of(snapshot_files.join(kept, "snapshot_id", "left_semi"))


def objects_of(files: DataFrame) -> DataFrame:
    """object_id, kind: files (id, chunks) and their chunks, each once."""
    files = files.select("id", "chunks").dropDuplicates(["id"])
    both = F.explode(F.array_union(F.array(F.struct(F.col("id").alias("object_id"), F.lit("file").alias("kind"))), F.transform("chunks", lambda c: F.struct(c.alias("object_id"), F.lit("chunk").alias("kind")))))
    return files.select(both.alias("o")).select("o.*").distinct()


def garbage(objects: DataFrame, live: DataFrame) -> DataFrame:
    """Stored objects that nothing reaches. What isn't a valid object id is never garbage."""
    return objects.where(valid_object_id("object_id")).join(live.select("object_id").distinct(), "object_id", "left_anti")


def purge_stat(dead_snapshots: DataFrame, dead_objects: DataFrame) -> DataFrame:
    """One row: snapshots, objects and stored bytes that a purge would remove."""
    a = dead_snapshots.agg(F.count("*").alias("snapshots"))
    return a.crossJoin(dead_objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")))  # one row each


def check_index_cleanup(checks: DataFrame, snapshots: DataFrame, kept: DataFrame) -> DataFrame:
    """Check indexes whose snapshot is neither referenced nor there any more."""
    return checks.join(kept, "snapshot_id", "left_anti").join(snapshots.select("snapshot_id"), "snapshot_id", "left_anti")


def retained_list(listed: DataFrame, kept: DataFrame) -> DataFrame:
    """Entries of the cloud's snapshot list that a reference names."""
    return listed.join(kept, "snapshot_id", "left_semi")


def missing_chunks_of(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, chunk_id of files' chunks that are not stored: any row is fatal."""
    return files.select("path", F.explode("chunks").alias("chunk_id")).distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti")
