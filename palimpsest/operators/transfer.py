"""Transfer planning: what is missing where, from whom to get it, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_chunks(files: DataFrame) -> DataFrame:
    return files.select(F.explode("chunks").alias("chunk_id")).distinct()


def missing_files(needed: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct ids of needed files that are not stored."""
    return needed.select("id").distinct().join(stored.select("id"), "id", "left_anti")


def missing_chunks(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct chunk ids of files that are not stored."""
    return distinct_chunks(files).join(stored.select("chunk_id"), "chunk_id", "left_anti")


def upload_files(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Local file versions whose id the cloud snapshot lacks. Complete: an unreadable file is an error elsewhere, not a gap."""
    return local.join(cloud.select("id").distinct(), "id", "left_anti")


def upload_chunks(files: DataFrame, cloud_files: DataFrame) -> DataFrame:
    """Distinct chunks of files to upload that no cloud file has."""
    return distinct_chunks(files).join(distinct_chunks(cloud_files), "chunk_id", "left_anti")


def routes(needed: DataFrame, inventory: DataFrame, peers: DataFrame) -> DataFrame:
    """object_id, peers (names, most recently seen first): the cloud is the way for objects without a peer."""
    held = needed.join(inventory, "object_id", "left").join(peers, "peer_id", "left")
    order = F.array_sort(F.collect_list(F.when(F.col("peer_id").isNotNull(), F.struct((-F.col("last_seen")).alias("age"), "peer_id"))))
    return held.groupBy("object_id").agg(F.transform(order, lambda x: x["peer_id"]).alias("peers"))


def fetched(routed: DataFrame, attempts: DataFrame) -> DataFrame:
    """object_id, source: the first peer of the route whose answer is valid, else the cloud. attempts: object_id, peer_id, valid."""
    tried = routed.select("object_id", F.posexplode_outer("peers").alias("rank", "peer_id")).join(attempts, ["object_id", "peer_id"], "left")
    return tried.groupBy("object_id").agg(F.coalesce(F.min_by(F.when(F.col("valid"), F.col("peer_id")), F.when(F.col("valid"), F.col("rank"))), F.lit("cloud")).alias("source"))


def traffic(transfers: DataFrame) -> DataFrame:
    """One row of counters over transfers (kind, direction, source, decoded_bytes, encoded_bytes): cloud bytes as decoded, peer bytes as encoded."""
    def n(c):
        return F.count_if(c)

    cloud, down, chunk = F.col("source") == "cloud", F.col("direction") == "down", F.col("kind") == "chunk"
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    return transfers.agg(
        n(down & chunk).alias("download_chunks"), n(down & ~chunk).alias("download_files"), n(~down & chunk).alias("upload_chunks"), n(~down & ~chunk).alias("upload_files"),
        total(down & cloud, "decoded_bytes").alias("cloud_download_decoded_bytes"), total(down & ~cloud, "encoded_bytes").alias("peer_download_encoded_bytes"), total(~down, "decoded_bytes").alias("upload_decoded_bytes"),
        n(cloud & down).alias("api_get"), n(cloud & ~down).alias("api_put"),
    )


def repair(missing: DataFrame, local: DataFrame) -> DataFrame:
    """object_id, repairable: cloud objects reported missing, and whether they can be uploaded from here."""
    return missing.distinct().join(local.select("object_id", F.lit(True).alias("here")), "object_id", "left").select("object_id", F.coalesce("here", F.lit(False)).alias("repairable"))


def quota_error(used: Column, added: Column, available: Column, count: Column | None = None, most: int = 12) -> Column:
    """Why a transfer may not start; null if it may."""
    out = F.when(available <= added, "size exceeds the space left")
    if count is not None:
        out = out.when(count >= most, "too many backups")
    return out.when(available <= used + added, "repository would exceed the space left")


def dedup_puts(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows that a skip-if-exists put would write: the first of each key in arrival order, unless it is stored."""
    w = Window.partitionBy(key).orderBy("ordinal")
    return incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(stored.select(key), key, "left_anti")


def prepended(listed: DataFrame, latest: DataFrame) -> DataFrame:
    """The cloud's snapshot list with the latest in front, each id where it first stands; unchanged if it is there already."""
    present = listed.join(latest.select("snapshot_id"), "snapshot_id", "left_semi").agg(F.count("*").alias("there"))
    rows = latest.select("snapshot_id", F.lit(-1).alias("ordinal")).unionByName(listed.select("snapshot_id", "ordinal"))
    first = rows.crossJoin(F.broadcast(present)).where((F.col("ordinal") >= 0) | (F.col("there") == 0)).groupBy("snapshot_id").agg(F.min("ordinal").alias("ordinal"))  # `present` is one row
    return first


def sequence_latest(sequence_refs: DataFrame) -> DataFrame:
    """The id of the greatest sequence number above zero; of equal ones the least id."""
    return sequence_refs.where("seq > 0").agg(F.max("seq").alias("seq"), F.min_by("snapshot_id", F.struct(-F.col("seq"), F.col("snapshot_id"))).alias("snapshot_id")).select("seq", "snapshot_id").where("seq IS NOT NULL")


def resolved_latest(by_ref: DataFrame, by_sequence: DataFrame) -> DataFrame:
    """Of two candidates (repo, snapshot_id, created) the one created later; on a tie the reference's."""
    both = by_ref.select("repo", F.struct("created", F.lit(1).alias("ref"), "snapshot_id").alias("c")).unionByName(by_sequence.select("repo", F.struct("created", F.lit(0).alias("ref"), "snapshot_id").alias("c")))
    return both.groupBy("repo").agg(F.max("c").alias("c")).select("repo", "c.snapshot_id", "c.created")


#: The order in which a snapshot becomes visible: what it needs, then itself, then names for it.
PUBLISH_STEPS = ((1, "chunks"), (2, "files"), (3, "snapshot"), (3, "check-index"), (4, "ref-latest"), (4, "seq-ref"), (4, "index-list"))
