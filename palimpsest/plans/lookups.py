"""Queries that read single objects and references, and the merge with view-only changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import chunks, folders, merge, reach

from .fixtures import DOCUMENT_FILES_SQL, LOG_SQL, SIDES_SQL, SNAPSHOT_FILES_SQL, document_files, log, refs, side_conditions, snapshot_files, snapshot_id, snapshots, version_intervals
from .merging import DECIDE_SQL, OUT, WIDE_SQL


def snapshot_by_id(spark, sf_dir):
    """One snapshot's row and number of files, by id."""
    files = snapshot_files(spark, sf_dir).where(F.col("snapshot_id") == snapshot_id(F.lit(12))).groupBy("snapshot_id").agg(F.count("*").alias("n_files"))
    return snapshots(spark).join(files, "snapshot_id").select("snapshot_id", "created", "memo", "n_files")


def files_by_ids(spark, sf_dir):
    """All versions with an id that snapshot 30 names."""
    named = snapshot_files(spark, sf_dir).where("snap = 30").select("id")
    return log(spark, sf_dir).where("live").select("id", "path", "updated").distinct().join(named, "id", "left_semi")


def chunks_by_ids(spark, sf_dir):
    """Stored chunks by the ids of the first lines of all documents."""
    d = document_files(spark, sf_dir)
    named = d.select(F.element_at("chunks", 1).alias("chunk_id"))
    return chunks.store(chunks.exploded(d)).join(named, "chunk_id", "left_semi").select("chunk_id", "size")


def latest_files(spark, sf_dir):
    """Files of the snapshot that the latest reference names."""
    return snapshot_files(spark, sf_dir).join(refs(spark).where("name = 'latest'").select("snapshot_id"), "snapshot_id", "left_semi").select("path", "id", "size")


def latest_sync_files(spark, sf_dir):
    """Per device, the number of files of its last sync; a missing or blank reference is an empty snapshot, not an error."""
    devices = spark.createDataFrame([("a", 20), ("b", None), ("c", 99)], "device string, d int").select("device", F.when(F.col("d").isNotNull(), snapshot_id(F.col("d"))).otherwise("").alias("snapshot_id"))
    counts = snapshot_files(spark, sf_dir).groupBy("snapshot_id").agg(F.count("*").alias("n"))
    return devices.join(counts, "snapshot_id", "left").select("device", F.coalesce("n", F.lit(0)).alias("n_files"))


def count_snapshots(spark, sf_dir):
    """Snapshots by well-formed name; other entries of the folder don't count."""
    odd = spark.createDataFrame([("short",), ("x" * 41,)], "snapshot_id string")
    return snapshots(spark).select("snapshot_id").unionByName(odd).where("length(snapshot_id) = 40").agg(F.count("*").alias("n"))


def merge_with_folds(spark, sf_dir):
    """The merge where documents of even users changed in view state alone: there the cloud wins what would be a conflict."""
    rows = merge.sides_of_log(log(spark, sf_dir), *side_conditions())
    return merge.decided(rows, fold_only=F.col("path").rlike("/u[0-9]*[02468]/k1[.]sy$")).select(*OUT)


FOLDS_SQL = f"""WITH {SIDES_SQL}, {WIDE_SQL}, {DECIDE_SQL}, f AS (SELECT *, conflict_type IS NOT DISTINCT FROM 'local-upsert-cloud-upsert' AND regexp_matches(path, '/u[0-9]*[02468]/k1[.]sy$') AS fold FROM d)
SELECT path, local_delta, cloud_delta, CASE WHEN fold THEN 'cloud' ELSE winner END AS winner, CASE WHEN NOT fold THEN conflict_type END AS conflict_type, CASE WHEN fold THEN 'local' ELSE history END AS history, publish AND NOT fold AS publish FROM f"""


def file_log(spark, sf_dir):
    """All versions of each path that snapshots hold, with the first and last snapshot of each."""
    spans = version_intervals(spark, sf_dir).groupBy("path", "id")
    return spans.agg(F.min("first").alias("first_snap"), (F.max("next") - 1).alias("last_snap"), F.sum(F.col("next") - F.col("first")).alias("n_snapshots"))


def unreferenced_snapshots(spark, sf_dir):
    return reach.unreferenced_snapshots(snapshots(spark), reach.referenced(refs(spark))).select("snapshot_id", "memo")


def union_of_ids(spark, sf_dir):
    """Distinct file ids of all snapshots, with the newest snapshot's number: the set that a search reads."""
    return version_intervals(spark, sf_dir).groupBy("id").agg((F.max("next") - 1).alias("newest"))


def checkout_ranks(spark, sf_dir):
    """How many files each step of a checkout writes."""
    return log(spark, sf_dir).where("live").select("path").distinct().groupBy(folders.checkout_rank().alias("rank")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    snapshot_by_id, files_by_ids, chunks_by_ids, latest_files, latest_sync_files, count_snapshots, merge_with_folds, file_log,
    unreferenced_snapshots, union_of_ids, checkout_ranks,
)}
ORACLE_SQL = {
    "snapshot_by_id": f"WITH {SNAPSHOT_FILES_SQL} SELECT s.snapshot_id, created, memo, count(*) AS n_files FROM snapshots s JOIN snapshot_files f USING (snapshot_id) WHERE s.snap = 12 GROUP BY ALL",
    "files_by_ids": f"WITH {SNAPSHOT_FILES_SQL} SELECT DISTINCT id, path, updated FROM log SEMI JOIN (SELECT id FROM snapshot_files WHERE snap = 30) n USING (id) WHERE live",
    "chunks_by_ids": f"WITH {DOCUMENT_FILES_SQL} SELECT DISTINCT chunk AS chunk_id, cast(strlen(line) AS bigint) AS size FROM file_chunks WHERE pos = 0",
    "latest_files": f"WITH {SNAPSHOT_FILES_SQL} SELECT path, id, size FROM snapshot_files WHERE snap = 30",
    "latest_sync_files": f"WITH {SNAPSHOT_FILES_SQL} SELECT 'a' AS device, count(*) AS n_files FROM snapshot_files WHERE snap = 20 UNION ALL SELECT * FROM (VALUES ('b', 0), ('c', 0))",
    "count_snapshots": "SELECT cast(30 AS bigint) AS n",
    "merge_with_folds": FOLDS_SQL,
    "file_log": f"WITH {SNAPSHOT_FILES_SQL} SELECT path, id, min(snap) AS first_snap, max(snap) AS last_snap, count(*) AS n_snapshots FROM snapshot_files GROUP BY 1, 2",
    "unreferenced_snapshots": f"WITH {SNAPSHOT_FILES_SQL} SELECT snapshot_id, memo FROM snapshots ANTI JOIN refs USING (snapshot_id)",
    "union_of_ids": f"WITH {SNAPSHOT_FILES_SQL} SELECT id, max(snap) AS newest FROM snapshot_files GROUP BY 1",
    "checkout_ranks": f"WITH {LOG_SQL}, p AS (SELECT DISTINCT path FROM log WHERE live) SELECT CASE split_part(path, '/', 2) WHEN '.app' THEN 0 WHEN 'assets' THEN 1 WHEN 'emojis' THEN 2 WHEN 'storage' THEN 3 WHEN 'plugins' THEN 4 WHEN 'widgets' THEN 5 WHEN 'templates' THEN 6 WHEN 'public' THEN 7 ELSE 8 END AS rank, count(*) AS n FROM p GROUP BY 1".replace(", p AS", ", q AS").replace("FROM p GROUP", "FROM q GROUP"),
}
