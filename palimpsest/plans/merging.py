"""Queries on two-way comparison and three-way merge."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from palimpsest.operators import diff, merge

from .fixtures import LOG_SQL, SIDES_SQL, before, log, side_conditions, state, state_sql

TWO_SQL = f"{LOG_SQL},\n{state_sql('a', 'snap <= 20')},\n{state_sql('b', 'snap <= 15')}"
PAIR_SQL = "j AS (SELECT coalesce(a.path, b.path) AS path, a.id AS l_id, b.id AS r_id, a.updated AS l_updated, b.updated AS r_updated FROM a FULL JOIN b ON a.path = b.path)"


def snapshot_diff(spark, sf_dir):
    d = diff.snapshot_diff(state(spark, sf_dir, 20), state(spark, sf_dir, 15))
    return d.select("path", "change_kind", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), F.col("l.updated").alias("left_updated"), F.col("r.updated").alias("right_updated"))


SNAPSHOT_DIFF = f"""WITH {TWO_SQL}, {PAIR_SQL}
SELECT path, CASE WHEN r_id IS NULL THEN 'add' WHEN l_id IS NULL THEN 'remove' ELSE 'update' END AS change_kind, l_id AS left_id, r_id AS right_id, l_updated AS left_updated, r_updated AS right_updated
FROM j WHERE l_id IS NULL OR r_id IS NULL OR l_updated // 1000 <> r_updated // 1000"""


def diff_upsert_remove(spark, sf_dir):
    return diff.upserts_and_removes(state(spark, sf_dir, 20), state(spark, sf_dir, 15)).select("path", "action", F.col("v.id").alias("id"), F.col("v.size").alias("size"))


DIFF_UPSERT_REMOVE = f"""WITH {TWO_SQL}
SELECT a.path, 'upsert' AS action, a.id, a.size FROM a LEFT JOIN b ON a.path = b.path WHERE b.path IS NULL OR a.updated // 1000 <> b.updated // 1000
UNION ALL SELECT b.path, 'remove', b.id, b.size FROM b ANTI JOIN a ON a.path = b.path"""

#: Versions that a side can have in the truth tables: none, or content and minutes and milliseconds.
STATES = (None, ("x", 0), ("x", 500), ("x", 60_000), ("y", 0), ("y", 60_000), ("z", 480_001), ("z", 480_000))


def _truth_rows(paths):
    def v(s):
        return None if s is None else (f"{s[0]}{s[1]}", 1, 1_700_000_000_000 + s[1], [s[0]])

    return [(f"{p}{n}{suffix}", v(b), v(l), v(c)) for p, suffix in paths for n, (b, l, c) in enumerate(product(STATES, repeat=3))]


def _truth(spark, paths=(("/case", ".txt"),)):
    v = "struct<id: string, size: bigint, updated: bigint, chunks: array<string>>"
    return spark.createDataFrame(_truth_rows(paths), f"path string, base {v}, local {v}, cloud {v}")


def _truth_sql(paths=(("/case", ".txt"),)):
    def v(s):
        return "NULL, NULL, NULL" if s is None else f"'{s[0]}{s[1]}', {1_700_000_000_000 + s[1]}, '{s[0]}'"

    rows = ", ".join(f"('{p}{n}{suffix}', {v(b)}, {v(l)}, {v(c)})" for p, suffix in paths for n, (b, l, c) in enumerate(product(STATES, repeat=3)))
    return f"""t(path, b_id, b_up, b_ch, l_id, l_up, l_ch, c_id, c_up, c_ch) AS (VALUES {rows}),
w AS (SELECT path, b_id, cast(b_up AS bigint) AS b_up, b_ch, 1 AS b_size, l_id, cast(l_up AS bigint) AS l_up, l_ch, 1 AS l_size, c_id, cast(c_up AS bigint) AS c_up, c_ch, 1 AS c_size FROM t)"""


WIDE_SQL = """w AS (SELECT path, b.id AS b_id, b.updated AS b_up, b.chunks AS b_ch, b.size AS b_size, l.id AS l_id, l.updated AS l_up, l.chunks AS l_ch, l.size AS l_size,
  c.id AS c_id, c.updated AS c_up, c.chunks AS c_ch, c.size AS c_size FROM base b FULL JOIN local l USING (path) FULL JOIN cloud c USING (path))"""


def _delta_sql(x):
    return f"""CASE WHEN b_id IS NULL AND {x}_id IS NULL THEN 'unchanged' WHEN b_id IS NULL THEN 'upsert' WHEN {x}_id IS NULL THEN 'remove'
    WHEN b_ch <> {x}_ch OR b_size <> {x}_size THEN 'upsert' WHEN b_up // 1000 <> {x}_up // 1000 THEN 'metadata-only' ELSE 'unchanged' END"""


DECIDE_SQL = f"""
d1 AS (SELECT *, {_delta_sql('l')} AS ld, {_delta_sql('c')} AS cd FROM w),
d2 AS (SELECT *, ld IN ('upsert', 'remove') AS lc, cd IN ('upsert', 'remove') AS cc,
  (l_id IS NULL AND c_id IS NULL) OR coalesce(l_ch = c_ch AND l_size = c_size, false) AS same,
  coalesce(l_up < c_up - 420000, false) AS l_old, coalesce(c_up < l_up - 420000, false) AS c_old,
  c_id IS NOT NULL AND (l_id IS NULL OR c_up > l_up OR (c_up = l_up AND c_id > l_id)) AS pc FROM d1),
d3 AS (SELECT *, CASE
  WHEN (same OR (NOT lc AND NOT cc)) AND ((ld = 'unchanged' AND cd = 'unchanged') OR (l_id IS NULL AND c_id IS NULL)) THEN 'none|||n'
  WHEN (same OR (NOT lc AND NOT cc)) AND pc THEN 'cloud|||n'
  WHEN (same OR (NOT lc AND NOT cc)) THEN 'local|||y'
  WHEN lc AND cc AND l_id IS NULL THEN 'local|local-remove-cloud-upsert|cloud|y'
  WHEN lc AND cc AND c_id IS NULL THEN 'local|local-upsert-cloud-remove|local|y'
  WHEN lc AND cc AND l_old THEN 'cloud|local-upsert-cloud-upsert|local|n'
  WHEN lc AND cc THEN 'local|local-upsert-cloud-upsert|cloud|y'
  WHEN lc AND l_old THEN 'cloud||local|n'
  WHEN lc THEN 'local|||y'
  WHEN c_old THEN 'local||cloud|y'
  ELSE 'cloud|||n' END AS o FROM d2),
d4 AS (SELECT *, split_part(o, '|', 1) AS win, nullif(split_part(o, '|', 2), '') AS con, nullif(split_part(o, '|', 3), '') AS his, split_part(o, '|', 4) = 'y' AS pub FROM d3),
d AS (SELECT path, b_id, b_up, b_ch, b_size, l_id, l_up, l_ch, l_size, c_id, c_up, c_ch, c_size, ld AS local_delta, cd AS cloud_delta, con AS conflict_type,
  CASE WHEN tmp THEN 'local' ELSE win END AS winner, CASE WHEN tmp THEN 'cloud' ELSE his END AS history, CASE WHEN tmp THEN con IS NOT NULL ELSE pub END AS publish
  FROM (SELECT *, win = 'cloud' AND c_id IS NOT NULL AND path LIKE '%.tmp' AS tmp FROM d4))"""


def merge_delta_truth(spark, sf_dir):
    return _truth(spark).select("path", merge.delta(F.col("base"), F.col("local")).alias("local_delta"), merge.delta(F.col("base"), F.col("cloud")).alias("cloud_delta"))


OUT = ("path", "local_delta", "cloud_delta", "winner", "conflict_type", "history", "publish")


def merge_decision_truth(spark, sf_dir):
    return merge.decided(_truth(spark)).select(*OUT)


def tmp_suppression(spark, sf_dir):
    return merge.decided(_truth(spark, (("/scratch", ".tmp"),))).select(*OUT)


TMP_SQL = _truth_sql((("/scratch", ".tmp"),))


def _decisions(spark, sf_dir):
    return merge.decided(merge.sides_of_log(log(spark, sf_dir), *side_conditions()))


def three_way_merge(spark, sf_dir):
    return _decisions(spark, sf_dir).select(*OUT, F.col("local.id").alias("local_id"), F.col("cloud.id").alias("cloud_id"))


def merge_of_lists(spark, sf_dir):
    base, local, cloud = (diff.as_of(log(spark, sf_dir), c) for c in side_conditions())
    return merge.merged(merge.decided(merge.sides(base, local, cloud))).select("path", "id", "size", "updated")


def merge_conflicts(spark, sf_dir):
    return merge.conflicts(_decisions(spark, sf_dir)).select("path", "winner", "conflict_type", F.col("copy.id").alias("copy_id"))


def conflict_counts(spark, sf_dir):
    return merge.conflicts(_decisions(spark, sf_dir)).groupBy("conflict_type", "winner").agg(F.count("*").alias("n"), F.count("copy").alias("copies"))


def merge_apply_set(spark, sf_dir):
    return merge.apply_set(_decisions(spark, sf_dir)).select("path", "action", F.col("v.id").alias("id"))


def merge_history(spark, sf_dir):
    from palimpsest.functions.scalars import history_folder

    now = F.lit(1_706_000_000_123)
    return merge.history(_decisions(spark, sf_dir)).select("path", "id", F.concat(F.lit("history/"), history_folder(now), F.col("path")).alias("history_path"))


APPLY_SQL = """SELECT path, CASE WHEN c_id IS NULL AND l_id IS NOT NULL THEN 'remove' ELSE 'upsert' END AS action, coalesce(c_id, l_id) AS id FROM d
WHERE winner = 'cloud' AND NOT (coalesce(l_id = c_id AND l_ch = c_ch AND l_size = c_size, false) OR (l_id IS NULL AND c_id IS NULL))"""


def merge_outcome(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return merge.outcome(d, merge.apply_set(d))


OUTCOME_SQL = f"""WITH {SIDES_SQL}, {WIDE_SQL}, {DECIDE_SQL}, a AS ({APPLY_SQL}),
o AS (SELECT (SELECT count(*) FROM a WHERE action = 'upsert') AS upserts, (SELECT count(*) FROM a WHERE action = 'remove') AS removes,
  (SELECT count(*) FROM d WHERE conflict_type IS NOT NULL) AS conflicts, (SELECT bool_or(local_delta <> 'unchanged' OR publish) FROM d) AS local_changed)
SELECT upserts, removes, conflicts, upserts + removes > 0 AS data_changed, local_changed,
  CASE WHEN upserts + removes > 0 AND local_changed THEN 'merge-snapshot' WHEN upserts + removes > 0 THEN 'fast-forward' ELSE 'keep-local' END AS snapshot FROM o"""


def missing_cloud_latest(spark, sf_dir):
    """Without a cloud latest, local files stand for the cloud's: nothing is applied, nothing conflicts."""
    base, local, _ = (diff.as_of(log(spark, sf_dir), c) for c in side_conditions())
    d = merge.decided(merge.sides(base, local, local))
    return merge.outcome(d, merge.apply_set(d))


MISSING_SQL = OUTCOME_SQL.replace("base b FULL JOIN local l USING (path) FULL JOIN cloud c USING (path)", "base b FULL JOIN local l USING (path) FULL JOIN local c USING (path)")


def merge_order(spark, sf_dir):
    """The merge's decisions with the place of each path."""
    return merge.in_path_order(_decisions(spark, sf_dir).select("path", "winner"))


def cloud_ignore_change(spark, sf_dir):
    """For each path of the top folder of plugins as ignore file: whether the cloud's version of it would hold back removals."""
    d = _decisions(spark, sf_dir).where("path LIKE '/plugins/%' AND cloud IS NOT NULL")
    return d.select("path", merge.ignore_counts().alias("counts"), F.col("cloud.id").alias("cloud_id"))


def remove_ignore_filter(spark, sf_dir):
    actions = merge.apply_set(_decisions(spark, sf_dir))
    return merge.spared_removes(actions, F.col("path").rlike("^/(assets|plugins)/")).select("path", "action", F.col("v.id").alias("id"))


def sync_download_plan(spark, sf_dir):
    base, local, cloud = (diff.as_of(log(spark, sf_dir), c) for c in side_conditions())
    return merge.download_plan(base, local, cloud)


DOWNLOAD_SQL = f"""WITH {SIDES_SQL},
a AS (SELECT c.path, 'upsert' AS action, c.id FROM cloud c LEFT JOIN local l USING (path) WHERE l.id IS NULL OR c.updated // 1000 <> l.updated // 1000
  UNION ALL SELECT l.path, 'remove', l.id FROM local l ANTI JOIN cloud c USING (path)),
u AS (SELECT l.path, l.id FROM local l LEFT JOIN base b USING (path) WHERE b.id IS NULL OR l.updated // 1000 <> b.updated // 1000),
h AS (SELECT DISTINCT u.path FROM u JOIN a ON u.path = a.path OR u.id = a.id)
SELECT coalesce(a.path, h.path) AS path, action, id, h.path IS NOT NULL AS conflict FROM a FULL JOIN h ON a.path = h.path"""


def full_sync_plan(spark, sf_dir):
    """All of a sync in one table: the decision, and whether the file is applied, uploaded or kept in history."""
    d = _decisions(spark, sf_dir)
    applied = merge.apply_set(d).select("path", "action")
    upload = F.col("publish") & F.col("local").isNotNull()
    return d.join(applied, "path", "left").select("path", "winner", "action", upload.alias("upload"), F.col("history").isNotNull().alias("in_history"))


FULL_SYNC_SQL = f"""WITH {SIDES_SQL}, {WIDE_SQL}, {DECIDE_SQL}, a AS ({APPLY_SQL})
SELECT path, winner, action, publish AND l_id IS NOT NULL AS upload, history IS NOT NULL AS in_history FROM d LEFT JOIN a USING (path)"""


def fold_only_change(spark, sf_dir):
    """Documents of blocks, from the log: a path's first and last versions, with fold state that differs by event."""
    rows = log(spark, sf_dir).where("path LIKE '%.sy'")
    attrs = F.create_map(F.lit("id"), F.col("path"), F.lit("fold"), (F.col("event_id") % 2).cast("string"), F.lit("style"), (F.col("event_id") % 5 < 4).cast("string"), F.lit("updated"), F.col("updated").cast("string"))
    block = F.struct("event_id", attrs.alias("attrs"))
    both = rows.groupBy("path").agg(F.min_by(block, F.struct("ts", "event_id")).alias("b"), F.max_by(block, F.struct("ts", "event_id")).alias("l"))
    side = lambda s: both.select("path", F.lit("b0").alias("block_id"), F.lit("p").alias("kind"), (F.col(f"{s}.event_id") % 3 < 2).cast("string").alias("content"), F.col(f"{s}.attrs").alias("attrs"))
    return merge.fold_only_changes(side("l"), side("b"))


FOLD_SQL = f"""WITH {LOG_SQL}, x AS (SELECT path, first(event_id ORDER BY ts, event_id) AS b, last(event_id ORDER BY ts, event_id) AS l FROM log WHERE path LIKE '%.sy' GROUP BY 1)
SELECT path, (b % 3 < 2) = (l % 3 < 2) AND (b % 5 < 4) = (l % 5 < 4) AS fold_only FROM x"""


def _d(select: str, extra: str = "") -> str:
    return f"WITH {SIDES_SQL}, {WIDE_SQL}, {DECIDE_SQL}{extra}\n{select}"


QUERIES = {f.__name__: f for f in (
    snapshot_diff, diff_upsert_remove, merge_delta_truth, merge_decision_truth, tmp_suppression, three_way_merge, merge_of_lists,
    merge_conflicts, conflict_counts, merge_apply_set, merge_history, merge_outcome, missing_cloud_latest, merge_order, cloud_ignore_change,
    remove_ignore_filter, sync_download_plan, full_sync_plan, fold_only_change,
)}
_OUT = ", ".join(OUT)
ORACLE_SQL = {
    "snapshot_diff": SNAPSHOT_DIFF,
    "diff_upsert_remove": DIFF_UPSERT_REMOVE,
    "merge_delta_truth": f"WITH {_truth_sql()}, {DECIDE_SQL} SELECT path, local_delta, cloud_delta FROM d",
    "merge_decision_truth": f"WITH {_truth_sql()}, {DECIDE_SQL} SELECT {_OUT} FROM d",
    "tmp_suppression": f"WITH {TMP_SQL}, {DECIDE_SQL} SELECT {_OUT} FROM d",
    "three_way_merge": _d(f"SELECT {_OUT}, l_id AS local_id, c_id AS cloud_id FROM d"),
    "merge_of_lists": _d("SELECT path, CASE WHEN winner = 'cloud' THEN c_id ELSE l_id END AS id, CASE WHEN winner = 'cloud' THEN c_size ELSE l_size END AS size, CASE WHEN winner = 'cloud' THEN c_up ELSE l_up END AS updated FROM d WHERE CASE WHEN winner = 'cloud' THEN c_id ELSE l_id END IS NOT NULL"),
    "merge_conflicts": _d("SELECT path, winner, conflict_type, CASE WHEN winner = 'cloud' THEN l_id ELSE c_id END AS copy_id FROM d WHERE conflict_type IS NOT NULL"),
    "conflict_counts": _d("SELECT conflict_type, winner, count(*) AS n, count(CASE WHEN winner = 'cloud' THEN l_id ELSE c_id END) AS copies FROM d WHERE conflict_type IS NOT NULL GROUP BY 1, 2"),
    "merge_apply_set": _d(APPLY_SQL),
    "merge_history": _d("SELECT DISTINCT path, CASE history WHEN 'cloud' THEN c_id ELSE l_id END AS id, 'history/2024-01-23-085320-sync' || path AS history_path FROM d WHERE CASE history WHEN 'cloud' THEN c_id WHEN 'local' THEN l_id END IS NOT NULL"),
    "merge_outcome": OUTCOME_SQL,
    "missing_cloud_latest": MISSING_SQL,
    "merge_order": _d("SELECT path, winner, row_number() OVER (ORDER BY path) AS pos FROM d"),
    "cloud_ignore_change": _d("SELECT path, c_id AS cloud_id, NOT coalesce(l_up // 1000 = c_up // 1000 AND l_ch = c_ch AND l_size = c_size, false) AS counts FROM d WHERE path LIKE '/plugins/%' AND c_id IS NOT NULL"),
    "remove_ignore_filter": _d("SELECT * FROM a WHERE action <> 'remove' OR NOT regexp_matches(path, '^/(assets|plugins)/')", f", a AS ({APPLY_SQL})"),
    "sync_download_plan": DOWNLOAD_SQL,
    "full_sync_plan": FULL_SYNC_SQL,
    "fold_only_change": FOLD_SQL,
}
