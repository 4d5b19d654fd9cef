"""Queries on reachability, purge, transfer, backup and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import chunks, diff, reach, transfer

from .fixtures import DOCUMENT_FILES_SQL, LOG_SQL, SIDES_SQL, SNAPSHOT_FILES_SQL, before, document_files, log, refs, side_conditions, snapshot_files, snapshot_id, snapshots, state, state_sql, version_intervals

OBJECTS_SQL = """
objects AS (SELECT object_id, any_value(size) AS size FROM (SELECT id AS object_id, size FROM log WHERE live UNION ALL SELECT sha1(p1), cast(strlen(p1) AS bigint) FROM log WHERE live
  UNION ALL SELECT sha1(p2), cast(strlen(p2) AS bigint) FROM log WHERE live) GROUP BY 1)"""


def objects(spark, sf_dir):
    """object_id, size of everything that the log ever stored: file versions and chunks."""
    rows = log(spark, sf_dir).where("live")
    parts = F.transform(F.arrays_zip("chunks", "parts"), lambda x: F.struct(x["chunks"].alias("object_id"), F.octet_length(x["parts"]).cast("bigint").alias("size")))
    every = rows.select(F.explode(F.array_append(parts, F.struct(F.col("id").alias("object_id"), F.col("size").alias("size")))).alias("o")).select("o.*")
    return every.groupBy("object_id").agg(F.first("size").alias("size"))


def _kept(spark, retained=()):
    more = spark.createDataFrame([(d,) for d in retained], "d int").select(snapshot_id(F.col("d")).alias("snapshot_id")) if retained else None
    return reach.referenced(refs(spark), more)


def _live(spark, sf_dir, kept):
    return reach.objects_of(reach.in_kept(version_intervals(spark, sf_dir), snapshots(spark), kept))


def reachable_objects(spark, sf_dir):
    return _live(spark, sf_dir, _kept(spark))


REACH_SQL = f"""WITH {SNAPSHOT_FILES_SQL}, {OBJECTS_SQL},
f AS (SELECT DISTINCT id, chunks FROM snapshot_files SEMI JOIN refs USING (snapshot_id)),
live AS (SELECT id AS object_id, 'file' AS kind FROM f UNION SELECT unnest(string_split(chunks, ',')), 'chunk' FROM f)"""


def purge_plan(spark, sf_dir):
    return reach.garbage(objects(spark, sf_dir), reachable_objects(spark, sf_dir))


def _stat(spark, sf_dir, retained=()):
    kept = _kept(spark, retained)
    dead = reach.unreferenced_snapshots(snapshots(spark), kept)
    return reach.purge_stat(dead, reach.garbage(objects(spark, sf_dir), _live(spark, sf_dir, kept)))


def purge_stat(spark, sf_dir):
    return _stat(spark, sf_dir)


def purge_with_retention(spark, sf_dir):
    return _stat(spark, sf_dir, (5, 15, 25))


STAT = """SELECT (SELECT count(*) FROM snapshots ANTI JOIN refs USING (snapshot_id)) AS snapshots, count(*) AS objects, cast(coalesce(sum(size), 0) AS bigint) AS bytes FROM objects ANTI JOIN live USING (object_id)"""
RETAIN = "('v10', 'tag', 10), ('a', 'keep', 5), ('b', 'keep', 15), ('c', 'keep', 25)"


def cloud_purge_plan(spark, sf_dir):
    """The cloud's side of a purge, from listings: paths of dead objects, and what is no object is left alone."""
    listed = objects(spark, sf_dir).select(S.object_path("object_id").alias("path"), "size")
    odd = spark.createDataFrame([("ab", 1), ("tags/v10", 42)], "path string, size bigint")
    rows = listed.unionByName(odd).select(S.object_id("path").alias("object_id"), "path", "size")
    return reach.garbage(rows, reachable_objects(spark, sf_dir)).select("path", "size")


def check_index_cleanup(spark, sf_dir):
    """Every third snapshot has lost its index; all have check indexes."""
    checks = snapshots(spark).select(F.sha1(F.concat(F.lit("check-"), F.col("snap").cast("string"))).alias("check_id"), "snapshot_id")
    there = snapshots(spark).where("snap % 3 <> 0")
    return reach.check_index_cleanup(checks, there, _kept(spark))


def missing_files(spark, sf_dir):
    return transfer.missing_files(state(spark, sf_dir, 20), state(spark, sf_dir, 15))


def _stored(files):
    return transfer.distinct_chunks(files)


def missing_chunks(spark, sf_dir):
    return transfer.missing_chunks(state(spark, sf_dir, 20), _stored(state(spark, sf_dir, 15)))


def _sides(spark, sf_dir):
    return [diff.as_of(log(spark, sf_dir), c) for c in side_conditions()]


def sync_upload_plan(spark, sf_dir):
    """Upload-only sync: files the cloud lacks and all their chunks that no cloud file has; the store is not asked."""
    _, local, cloud = _sides(spark, sf_dir)
    files = transfer.upload_files(local, cloud)
    new = transfer.upload_chunks(files, cloud)
    return files.select(F.col("id").alias("object_id"), F.lit("file").alias("kind")).unionByName(new.select(F.col("chunk_id").alias("object_id"), F.lit("chunk").alias("kind")))


UPLOAD = """up AS (SELECT * FROM local ANTI JOIN cloud USING (id)), uc AS (SELECT DISTINCT unnest(string_split(chunks, ',')) AS c FROM up), cc AS (SELECT DISTINCT unnest(string_split(chunks, ',')) AS c FROM cloud)"""


def upload_chunks(spark, sf_dir):
    _, local, cloud = _sides(spark, sf_dir)
    return transfer.upload_chunks(transfer.upload_files(local, cloud), cloud)


def cloud_absent_chunks(spark, sf_dir):
    """Line chunks of documents that a store, which has those of even documents, lacks."""
    d = document_files(spark, sf_dir)
    return transfer.missing_chunks(d, _stored(d.where("doc_id % 2 = 0")))


def chunk_dedup(spark, sf_dir):
    return chunks.dedup_stat(chunks.exploded(document_files(spark, sf_dir)))


def distinct_chunks(spark, sf_dir):
    return transfer.distinct_chunks(document_files(spark, sf_dir))


def reassemble_file(spark, sf_dir):
    d = document_files(spark, sf_dir)
    stored = chunks.store(chunks.exploded(d))
    return chunks.reassembled(d, stored, "\n").select("path", F.sha1("content").alias("content_sha1"), F.length("content").cast("bigint").alias("n_chars"), "missing")


def dedup_puts(spark, sf_dir):
    """Chunks that a put of all documents writes, when the store has those of documents below 100."""
    pieces = chunks.exploded(document_files(spark, sf_dir)).withColumn("ordinal", F.struct("path", "pos"))
    doc = F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("bigint")
    return transfer.dedup_puts(pieces, pieces.where(doc < 100).select("chunk_id").distinct(), "chunk_id").select("chunk_id", "path", "pos")


def integrity_check(spark, sf_dir):
    """Lines of documents whose digest begins with 0 are missing from the store."""
    d = document_files(spark, sf_dir)
    return reach.missing_chunks_of(d, _stored(d).where("chunk_id NOT LIKE '0%'"))


PEERS = (("p1", 1_000), ("p2", 3_000), ("p3", 2_000))
HELD = {"p1": "012345", "p2": "456789", "p3": "89ab"}


def _routes(spark, sf_dir):
    need = _stored(document_files(spark, sf_dir)).withColumnRenamed("chunk_id", "object_id")
    peers = spark.createDataFrame(PEERS, "peer_id string, last_seen bigint")
    digits = spark.createDataFrame(list(HELD.items()), "peer_id string, digits string").select("peer_id", F.explode(F.split("digits", "")).alias("digit")).where("digit <> ''")
    inventory = need.withColumn("digit", F.substring("object_id", 1, 1)).join(digits, "digit").select("object_id", "peer_id")
    return transfer.routes(need, inventory, peers)


def peer_routing(spark, sf_dir):
    return _routes(spark, sf_dir).select("object_id", F.concat_ws(",", "peers").alias("route"))


def peer_fetch(spark, sf_dir):
    """Peers answer; an answer whose second digit is 3 or less is corrupt, so the next peer or the cloud serves."""
    routed = _routes(spark, sf_dir)
    answers = routed.select("object_id", F.explode("peers").alias("peer_id")).withColumn("valid", (F.col("peer_id") != "p2") | (F.substring("object_id", 2, 1) > "3"))
    return transfer.fetched(routed, answers)


NEED_SQL = f"""WITH {DOCUMENT_FILES_SQL}, need AS (SELECT DISTINCT chunk AS object_id FROM file_chunks),
peers(peer_id, last_seen, digits) AS (VALUES ('p1', 1000, '012345'), ('p2', 3000, '456789'), ('p3', 2000, '89ab')),
held AS (SELECT object_id, peer_id, last_seen FROM need JOIN peers ON contains(digits, object_id[1:1]))"""


def transfer_traffic(spark, sf_dir):
    """Counters over the log as transfers: errors go down, other events up; peers serve even users; encoding adds 28 bytes."""
    rows = log(spark, sf_dir).select(
        F.when(F.col("event_id") % 4 == 0, "file").otherwise("chunk").alias("kind"), F.when(F.col("live"), "up").otherwise("down").alias("direction"),
        F.when(F.col("live") | (F.col("user_id") % 2 == 1), "cloud").otherwise("peer").alias("source"), F.col("size").alias("decoded_bytes"), (F.col("size") + 28).alias("encoded_bytes"),
    )
    return transfer.traffic(rows)


TRAFFIC_SQL = f"""WITH {LOG_SQL}, t AS (SELECT event_id % 4 = 0 AS file, live AS up, live OR user_id % 2 = 1 AS cloud, size FROM log)
SELECT count(*) FILTER (NOT up AND NOT file) AS download_chunks, count(*) FILTER (NOT up AND file) AS download_files, count(*) FILTER (up AND NOT file) AS upload_chunks, count(*) FILTER (up AND file) AS upload_files,
  cast(sum(size) FILTER (NOT up AND cloud) AS bigint) AS cloud_download_decoded_bytes, cast(sum(size + 28) FILTER (NOT up AND NOT cloud) AS bigint) AS peer_download_encoded_bytes, cast(sum(size) FILTER (up) AS bigint) AS upload_decoded_bytes,
  count(*) FILTER (cloud AND NOT up) AS api_get, count(*) FILTER (cloud AND up) AS api_put FROM t"""


def missing_object_repair(spark, sf_dir):
    need = _stored(document_files(spark, sf_dir)).withColumnRenamed("chunk_id", "object_id")
    return transfer.repair(need.where("object_id LIKE '0%'"), need.where("substring(object_id, 2, 1) < '8'"))


def backup_upload_plan(spark, sf_dir):
    """Snapshot v10 against the cloud's latest (20): files it lacks, and their chunks that the store lacks."""
    tag, cloud = state(spark, sf_dir, 10), state(spark, sf_dir, 20)
    files = transfer.upload_files(tag, cloud)
    absent = transfer.missing_chunks(files, _stored(cloud))
    return files.select(F.col("id").alias("object_id"), F.lit("file").alias("kind")).unionByName(absent.select(F.col("chunk_id").alias("object_id"), F.lit("chunk").alias("kind")))


def backup_download_plan(spark, sf_dir):
    """Snapshot v10 to a store that has snapshot 20: missing files, and missing chunks of all the snapshot's files."""
    tag, here = state(spark, sf_dir, 10), state(spark, sf_dir, 20)
    absent = transfer.missing_chunks(tag, _stored(here))
    return transfer.missing_files(tag, here).select(F.col("id").alias("object_id"), F.lit("file").alias("kind")).unionByName(absent.select(F.col("chunk_id").alias("object_id"), F.lit("chunk").alias("kind")))


BACKUP_SQL = f"""WITH {LOG_SQL}, {state_sql('tag', 'snap <= 10')}, {state_sql('here', 'snap <= 20')}, f AS (SELECT * FROM tag ANTI JOIN here USING (id)),
hc AS (SELECT DISTINCT unnest(string_split(chunks, ',')) AS c FROM here)
SELECT DISTINCT id AS object_id, 'file' AS kind FROM f UNION ALL SELECT DISTINCT c, 'chunk' FROM (SELECT unnest(string_split(chunks, ',')) AS c FROM {{}}) ANTI JOIN hc USING (c)"""


def prefetch_plan(spark, sf_dir):
    """Cloud files and chunks to fetch before a merge: nothing is decided yet."""
    _, local, cloud = _sides(spark, sf_dir)
    absent = transfer.missing_chunks(cloud, _stored(local))
    return transfer.missing_files(cloud, local).select(F.col("id").alias("object_id"), F.lit("file").alias("kind")).unionByName(absent.select(F.col("chunk_id").alias("object_id"), F.lit("chunk").alias("kind")))


PREFETCH_SQL = f"""WITH {SIDES_SQL}, lc AS (SELECT DISTINCT unnest(string_split(chunks, ',')) AS c FROM local)
SELECT DISTINCT id AS object_id, 'file' AS kind FROM cloud ANTI JOIN local USING (id) UNION ALL SELECT DISTINCT c, 'chunk' FROM (SELECT unnest(string_split(chunks, ',')) AS c FROM cloud) ANTI JOIN lc USING (c)"""


def publish_plan(spark, sf_dir):
    """Objects of the snapshot's upload and the names it gets, each with the step in which it becomes visible."""
    steps = dict((k, s) for s, k in transfer.PUBLISH_STEPS)
    up = sync_upload_plan(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")).select(F.when(F.col("kind") == "file", "files").otherwise("chunks").alias("what"), "n")
    names = spark.createDataFrame([(k, 1) for _, k in transfer.PUBLISH_STEPS if k not in ("files", "chunks")], "what string, n bigint")
    step = F.element_at(F.create_map(*(x for k, s in steps.items() for x in (F.lit(k), F.lit(s)))), F.col("what"))
    return up.unionByName(names).select(step.alias("step"), "what", "n")


PUBLISH_SQL = f"""WITH {SIDES_SQL}, {UPLOAD}
SELECT 2 AS step, 'files' AS what, count(*) AS n FROM up UNION ALL SELECT 1, 'chunks', count(*) FROM (SELECT * FROM uc ANTI JOIN cc USING (c))
UNION ALL SELECT * FROM (VALUES (3, 'snapshot', 1), (3, 'check-index', 1), (4, 'ref-latest', 1), (4, 'seq-ref', 1), (4, 'index-list', 1))"""


def index_list_upsert(spark, sf_dir):
    """The list of snapshots 1 to 20, newest first, after 30 is put in front; and after 20 is put there again."""
    listed = snapshots(spark).where("snap <= 20").select("snapshot_id", (20 - F.col("snap")).alias("ordinal"))
    out = [transfer.prepended(listed, snapshots(spark).where(f"snap = {d}")).select(F.lit(d).alias("put"), "snapshot_id", "ordinal") for d in (30, 20)]
    return out[0].unionByName(out[1])


UPSERT_LIST_SQL = f"""WITH {SNAPSHOT_FILES_SQL}, l AS (SELECT snapshot_id, 20 - snap AS ordinal FROM snapshots WHERE snap <= 20)
SELECT 30 AS put, snapshot_id, ordinal FROM l UNION ALL SELECT 30, snapshot_id, -1 FROM snapshots WHERE snap = 30 UNION ALL SELECT 20, snapshot_id, ordinal FROM l"""


def index_list_retain(spark, sf_dir):
    return reach.retained_list(snapshots(spark).select("snapshot_id", (30 - F.col("snap")).alias("ordinal")), _kept(spark))


def seq_latest(spark, sf_dir):
    """Sequence references from the snapshots: a gap, a zero and a tie among them."""
    seq = snapshots(spark).select(F.when(F.col("snap") > 25, 25).when(F.col("snap") == 1, 0).otherwise(F.col("snap")).alias("seq"), "snapshot_id")
    return transfer.sequence_latest(seq)


def latest_resolution(spark, sf_dir):
    """Thirty repositories whose reference and greatest sequence name different snapshots; every third pair has equal times."""
    s = snapshots(spark).select(F.col("snap").alias("repo"), "snapshot_id", "created")
    by_seq = s.select("repo", F.sha1("snapshot_id").alias("snapshot_id"), (F.col("created") + F.col("repo") % 3 - 1).alias("created"))
    return transfer.resolved_latest(s, by_seq)


def quota_guard(spark, sf_dir):
    """Whether each snapshot could be backed up with 3,000 bytes used, 20 kB left and one backup a snapshot before it."""
    from palimpsest.operators.search import interval_stats

    sizes = interval_stats(version_intervals(spark, sf_dir), snapshots(spark)).join(snapshots(spark), "snapshot_id")
    error = transfer.quota_error(F.lit(3000), F.col("size"), F.lit(20_000), F.col("snap") - 1)
    return sizes.select("snap", "size", error.alias("error"))


QUOTA_SQL = f"""WITH {SNAPSHOT_FILES_SQL}, z AS (SELECT snap, cast(sum(size) AS bigint) AS size FROM snapshot_files GROUP BY 1)
SELECT snap, size, CASE WHEN 20000 <= size THEN 'size exceeds the space left' WHEN snap - 1 >= 12 THEN 'too many backups' WHEN 20000 <= 3000 + size THEN 'repository would exceed the space left' END AS error FROM z"""

CDC = {"least": 512, "most": 4096, "bits": 10}


def cdc_chunks(spark, sf_dir):
    """Documents cut by content with bounds that suit texts of a few kilobytes."""
    from .fixtures import table

    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return chunks.content_defined(d, **CDC)


QUERIES = {f.__name__: f for f in (
    reachable_objects, purge_plan, purge_stat, purge_with_retention, cloud_purge_plan, check_index_cleanup, missing_files, missing_chunks,
    sync_upload_plan, upload_chunks, cloud_absent_chunks, chunk_dedup, distinct_chunks, reassemble_file, dedup_puts, integrity_check,
    peer_routing, peer_fetch, transfer_traffic, missing_object_repair, backup_upload_plan, backup_download_plan, prefetch_plan,
    publish_plan, index_list_upsert, index_list_retain, seq_latest, latest_resolution, quota_guard, cdc_chunks,
)}
TWO = f"WITH {LOG_SQL}, {state_sql('a', 'snap <= 20')}, {state_sql('b', 'snap <= 15')}"
ORACLE_SQL = {
    "reachable_objects": f"{REACH_SQL} SELECT * FROM live",
    "purge_plan": f"{REACH_SQL} SELECT * FROM objects ANTI JOIN live USING (object_id)",
    "purge_stat": f"{REACH_SQL} {STAT}",
    "purge_with_retention": f"{REACH_SQL} {STAT}".replace("('v10', 'tag', 10)", RETAIN),
    "cloud_purge_plan": f"{REACH_SQL} SELECT object_id[1:2] || '/' || object_id[3:] AS path, size FROM objects ANTI JOIN live USING (object_id)",
    "check_index_cleanup": f"WITH {SNAPSHOT_FILES_SQL} SELECT snapshot_id, sha1('check-' || snap) AS check_id FROM snapshots ANTI JOIN refs USING (snapshot_id) WHERE snap % 3 = 0",
    "missing_files": f"{TWO} SELECT DISTINCT id FROM a ANTI JOIN b USING (id)",
    "missing_chunks": f"{TWO}, x AS (SELECT DISTINCT unnest(string_split(chunks, ',')) AS chunk_id FROM a), y AS (SELECT unnest(string_split(chunks, ',')) AS chunk_id FROM b) SELECT * FROM x ANTI JOIN y USING (chunk_id)",
    "sync_upload_plan": f"WITH {SIDES_SQL}, {UPLOAD} SELECT id AS object_id, 'file' AS kind FROM up UNION ALL SELECT c, 'chunk' FROM uc ANTI JOIN cc USING (c)",
    "upload_chunks": f"WITH {SIDES_SQL}, {UPLOAD} SELECT c AS chunk_id FROM uc ANTI JOIN cc USING (c)",
    "cloud_absent_chunks": f"WITH {DOCUMENT_FILES_SQL} SELECT DISTINCT chunk AS chunk_id FROM file_chunks ANTI JOIN (SELECT chunk FROM file_chunks WHERE doc_id % 2 = 0) h USING (chunk)",
    "chunk_dedup": f"WITH {DOCUMENT_FILES_SQL}, u AS (SELECT DISTINCT chunk, strlen(line) AS n FROM file_chunks) SELECT (SELECT count(*) FROM file_chunks) AS chunks, count(*) AS distinct_chunks, (SELECT cast(sum(strlen(line)) AS bigint) FROM file_chunks) AS bytes, cast(sum(n) AS bigint) AS distinct_bytes FROM u",
    "distinct_chunks": f"WITH {DOCUMENT_FILES_SQL} SELECT DISTINCT chunk AS chunk_id FROM file_chunks",
    "reassemble_file": f"WITH {DOCUMENT_FILES_SQL} SELECT '/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, sha1(text) AS content_sha1, cast(length(text) AS bigint) AS n_chars, cast(0 AS bigint) AS missing FROM documents WHERE text IS NOT NULL",
    "dedup_puts": f"WITH {DOCUMENT_FILES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY path, pos) AS rn FROM file_chunks) SELECT chunk AS chunk_id, path, cast(pos AS integer) AS pos FROM x ANTI JOIN (SELECT chunk FROM file_chunks WHERE doc_id < 100) h USING (chunk) WHERE rn = 1",
    "integrity_check": f"WITH {DOCUMENT_FILES_SQL} SELECT DISTINCT path, chunk AS chunk_id FROM file_chunks WHERE chunk LIKE '0%'",
    "peer_routing": f"{NEED_SQL} SELECT object_id, coalesce(string_agg(peer_id, ',' ORDER BY last_seen DESC) FILTER (peer_id IS NOT NULL), '') AS route FROM need LEFT JOIN held USING (object_id) GROUP BY 1",
    "peer_fetch": f"{NEED_SQL} SELECT object_id, coalesce(first(peer_id ORDER BY last_seen DESC) FILTER (peer_id <> 'p2' OR object_id[2:2] > '3'), 'cloud') AS source FROM need LEFT JOIN held USING (object_id) GROUP BY 1",
    "transfer_traffic": TRAFFIC_SQL,
    "missing_object_repair": f"{NEED_SQL} SELECT object_id, object_id[2:2] < '8' AS repairable FROM need WHERE object_id LIKE '0%'",
    "backup_upload_plan": BACKUP_SQL.format("f"),
    "backup_download_plan": BACKUP_SQL.format("tag"),
    "prefetch_plan": PREFETCH_SQL,
    "publish_plan": PUBLISH_SQL,
    "index_list_upsert": UPSERT_LIST_SQL,
    "index_list_retain": f"WITH {SNAPSHOT_FILES_SQL} SELECT snapshot_id, 30 - snap AS ordinal FROM snapshots SEMI JOIN refs USING (snapshot_id)",
    "seq_latest": f"WITH {SNAPSHOT_FILES_SQL} SELECT 25 AS seq, min(snapshot_id) AS snapshot_id FROM snapshots WHERE snap >= 25",
    "latest_resolution": f"WITH {SNAPSHOT_FILES_SQL} SELECT snap AS repo, CASE snap % 3 WHEN 2 THEN sha1(snapshot_id) ELSE snapshot_id END AS snapshot_id, created + CASE snap % 3 WHEN 2 THEN 1 ELSE 0 END AS created FROM snapshots",
    "quota_guard": QUOTA_SQL,
}
