"""The model's tables, derived from the driver's `events` and `documents`; and the same as DuckDB common table expressions.

events as a change log: an event writes a version of a path, an `error` event deletes it. Snapshot d (1 to 30) is the state
before 2024-01-01 + d days. documents as files: a document is a file, its lines are its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S

# Categories of paths, extensions, snapshots that references name.
CATEGORIES = ("assets", "emojis", "storage", "plugins", "widgets", "templates", "public", ".app", "notes")
SNAPSHOTS = 30
REFS = {"latest": 30, "latest-sync": 20, "v10": 10}
DAY_MS, START_MS = 86_400_000, 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, event_type, user_id, snap (the first snapshot that sees it), path, id, size, updated, chunks, parts, live."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    category = F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (F.col("user_id") % 9 + 1).cast("int"))
    extension = F.when(F.col("k") % 10 == 0, ".tmp").when(F.col("k") % 10 == 1, ".sy").otherwise(".txt")
    e = e.withColumn("path", F.concat(F.lit("/"), category, F.lit("/u"), F.col("user_id").cast("string"), F.lit("/k"), (F.col("k") % 10).cast("string"), extension))
    e = e.withColumn("updated", S.epoch_ms("ts")).withColumn("parts", F.array(F.concat("event_type", F.lit(":")), F.floor(F.col("value") * 100 + 0.5).cast("bigint").cast("string")))
    return e.select(
        "event_id", "ts", "user_id", "event_type", (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("snap"), "path", S.file_id("path", "updated").alias("id"),
        F.octet_length(F.concat_ws("", "parts")).cast("bigint").alias("size"), "updated", F.transform("parts", S.chunk_id).alias("chunks"), "parts", (F.col("event_type") != "error").alias("live"),
    )


def before(day: int):
    return F.col("snap") <= day


def version_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, id, size, updated, chunks, first, next: a version is in the snapshots from `first` to the one before `next`, its
    successor's. One window over the log, and a row a version, however many snapshots hold it."""
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    end = F.least(F.coalesce(F.lead("snap").over(w), F.lit(SNAPSHOTS + 1)), F.lit(SNAPSHOTS + 1))
    rows = log(spark, sf_dir).withColumn("next", end).where("live AND next > snap")
    return rows.select("path", "id", "size", "updated", "chunks", F.col("snap").alias("first"), "next")


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snap, snapshot_id, path, id, size, updated, chunks: a row for each snapshot that holds a version. Where intervals do, use them."""
    rows = version_intervals(spark, sf_dir).withColumn("snap", F.explode(F.expr("sequence(first, next - 1)")))
    return rows.select("snap", snapshot_id(F.col("snap")).alias("snapshot_id"), "path", "id", "size", "updated", "chunks")


def snapshot_id(snap):
    return F.sha1(F.concat(F.lit("snap-"), snap.cast("string")))


def snapshots(spark: SparkSession) -> DataFrame:
    """snap, snapshot_id, created, memo, system: one row a snapshot."""
    s = spark.range(1, SNAPSHOTS + 1, 1, 1).select(F.col("id").cast("int").alias("snap"))
    return s.select("snap", snapshot_id(F.col("snap")).alias("snapshot_id"), (START_MS + F.col("snap").cast("bigint") * DAY_MS).alias("created"), F.concat(F.lit("day "), F.col("snap").cast("string")).alias("memo"))


def refs(spark: SparkSession) -> DataFrame:
    """name, kind, snapshot_id."""
    rows = [(n, "tag" if n.startswith("v") else "ref", d) for n, d in REFS.items()]
    r = spark.createDataFrame(rows, "name string, kind string, d int")
    return r.select("name", "kind", snapshot_id(F.col("d")).alias("snapshot_id"))


def state(spark: SparkSession, sf_dir: str, snap: int) -> DataFrame:
    from palimpsest.operators.diff import as_of

    return as_of(log(spark, sf_dir), before(snap))


def side_conditions():
    """Which log rows base, local and cloud have seen: ten days in common, then ten days with a third missing on each side."""
    base, ten = before(10), before(20)
    return base, base | (ten & (F.col("event_id") % 3 != 1)), base | (ten & (F.col("event_id") % 3 != 0))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, doc_id, lines (array), chunks (their ids). A null lang or source is an empty folder name, so that it has a path."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.split("text", "\n", -1)
    return d.select(F.concat(F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "doc_id", lines.alias("lines"), F.transform(lines, S.chunk_id).alias("chunks"))


LOG_SQL = """
e AS (SELECT *, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events),
p AS (SELECT *, '/' || (['assets', 'emojis', 'storage', 'plugins', 'widgets', 'templates', 'public', '.app', 'notes'])[cast(user_id % 9 + 1 AS integer)]
  || '/u' || user_id || '/k' || (k % 10) || CASE k % 10 WHEN 0 THEN '.tmp' WHEN 1 THEN '.sy' ELSE '.txt' END AS path, epoch_us(ts) // 1000 AS updated,
  event_type || ':' AS p1, cast(cast(floor(value * 100 + 0.5) AS bigint) AS varchar) AS p2 FROM e),
log AS (SELECT event_id, ts, user_id, event_type, cast(date_diff('day', DATE '2024-01-01', cast(ts AS date)) + 1 AS integer) AS snap, path,
  sha1(path || (updated // 1000)) AS id, cast(strlen(p1 || p2) AS bigint) AS size, updated, sha1(p1) || ',' || sha1(p2) AS chunks, p1, p2, event_type <> 'error' AS live FROM p)"""


def state_sql(name: str, condition: str) -> str:
    return f"""{name} AS (SELECT path, id, size, updated, chunks FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE {condition}) WHERE rn = 1 AND live)"""


SIDES_SQL = ",\n".join([
    LOG_SQL,
    state_sql("base", "snap <= 10"),
    state_sql("local", "snap <= 10 OR (snap <= 20 AND event_id % 3 <> 1)"),
    state_sql("cloud", "snap <= 10 OR (snap <= 20 AND event_id % 3 <> 0)"),
])

SNAPSHOTS_SQL = """
snapshots AS (SELECT cast(d AS integer) AS snap, sha1('snap-' || d) AS snapshot_id, cast(1704067200000 + d * 86400000 AS bigint) AS created, 'day ' || d AS memo FROM range(1, 31) t(d)),
refs AS (SELECT name, kind, sha1('snap-' || d) AS snapshot_id FROM (VALUES ('latest', 'ref', 30), ('latest-sync', 'ref', 20), ('v10', 'tag', 10)) t(name, kind, d))"""
SNAPSHOT_FILES_SQL = LOG_SQL + "," + SNAPSHOTS_SQL + """,
snapshot_files AS (SELECT snap, snapshot_id, path, id, size, updated, chunks FROM (
  SELECT s.snap, s.snapshot_id, l.path, l.id, l.size, l.updated, l.chunks, l.live, row_number() OVER (PARTITION BY s.snap, l.path ORDER BY l.ts DESC, l.event_id DESC) AS rn
  FROM snapshots s JOIN log l ON l.snap <= s.snap) WHERE rn = 1 AND live)"""
DOCUMENT_FILES_SQL = """
document_files AS (SELECT '/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
file_lines AS (SELECT path, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM document_files),
file_chunks AS (SELECT path, doc_id, pos, line, sha1(line) AS chunk FROM file_lines)"""
