"""Three-way merge of file lists: deltas, decisions, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.versions import prefers_cloud, same_content, same_second, same_version, stale

from .diff import VERSION, upserts_and_removes, version

# Names of outcomes.
UNCHANGED, UPSERT, REMOVE, METADATA = "unchanged", "upsert", "remove", "metadata-only"
NONE, LOCAL, CLOUD = "none", "local", "cloud"
REMOVE_UPSERT, UPSERT_REMOVE, UPSERT_UPSERT = "local-remove-cloud-upsert", "local-upsert-cloud-remove", "local-upsert-cloud-upsert"
SCRATCH_SUFFIX, DOCUMENT_SUFFIX = ".tmp", ".sy"

B, L, C = "base", "local", "cloud"


def sides(base: DataFrame, local: DataFrame, cloud: DataFrame) -> DataFrame:
    """path, base, local, cloud: a tagged union and one aggregate, so each list is shuffled once."""
    tagged = [df.select("path", F.lit(tag).alias("side"), version().alias("v")) for tag, df in ((B, base), (L, local), (C, cloud))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return rows.groupBy("path").agg(*(F.max(F.when(F.col("side") == tag, F.col("v"))).alias(tag) for tag in (B, L, C)))


def sides_of_log(log: DataFrame, base: Column, local: Column, cloud: Column) -> DataFrame:
    """The same from one change log and which of its rows each side has seen: one scan, one aggregate."""
    at = F.struct("ts", "event_id")
    v = F.struct("live", *VERSION)
    newest = log.groupBy("path").agg(*(F.max_by(F.when(seen, v), F.when(seen, at)).alias(tag) for tag, seen in ((B, base), (L, local), (C, cloud))))
    live = [F.when(F.col(f"{tag}.live"), F.struct(*(F.col(f"{tag}.{c}").alias(c) for c in VERSION))).alias(tag) for tag in (B, L, C)]
    return newest.select("path", *live).where("base IS NOT NULL OR local IS NOT NULL OR cloud IS NOT NULL")


def delta(base: Column, current: Column) -> Column:
    return (
        F.when(base.isNull() & current.isNull(), UNCHANGED)
        .when(base.isNull(), UPSERT)
        .when(current.isNull(), REMOVE)
        .when(~same_content(base, current), UPSERT)
        .when(~same_second(base, current), METADATA)
        .otherwise(UNCHANGED)
    )


#: Outcomes by code: winner, conflict type, side kept in history, publish.
OUTCOMES = (
    (NONE, None, None, False),
    (CLOUD, None, None, False),
    (LOCAL, None, None, True),
    (LOCAL, REMOVE_UPSERT, CLOUD, True),
    (LOCAL, UPSERT_REMOVE, LOCAL, True),
    (CLOUD, UPSERT_UPSERT, LOCAL, False),
    (LOCAL, UPSERT_UPSERT, CLOUD, True),
    (CLOUD, None, LOCAL, False),
    (LOCAL, None, CLOUD, True),
    (LOCAL, None, CLOUD, False),
)
_CODE = {o: k for k, o in enumerate(OUTCOMES)}


def _field(code: Column, k: int) -> Column:
    """A field of the outcome, looked up in a constant array."""
    kind = "boolean" if k == 3 else "string"
    return F.get(F.array(*(F.lit(o[k]).cast(kind) for o in OUTCOMES)), code)


def decided(rows: DataFrame, fold_only: Column | None = None) -> DataFrame:
    """`rows` (path, base, local, cloud) with deltas, winner, conflict_type, history (the side kept in history) and publish.

    `fold_only` says where a local change is of no account (only view state changed): there the cloud wins without a
    conflict. A cloud version of a scratch file never wins.
    """
    b, l, c = F.col(B), F.col(L), F.col(C)
    d = rows.withColumn("local_delta", delta(b, l)).withColumn("cloud_delta", delta(b, c))
    changed_l, changed_c = (F.col(x).isin(UPSERT, REMOVE) for x in ("local_delta", "cloud_delta"))
    calm = same_content(l, c) | (~changed_l & ~changed_c)
    idle = (F.col("local_delta") == UNCHANGED) & (F.col("cloud_delta") == UNCHANGED)
    # One expression per row makes a small code; all else is looked up by it.
    code = (
        F.when(calm, F.when(idle | (l.isNull() & c.isNull()), 0).when(prefers_cloud(l, c), 1).otherwise(2))
        .when(changed_l & changed_c, F.when(l.isNull(), 3).when(c.isNull(), 4).when(stale(l, c), 5).otherwise(6))
        .when(changed_l, F.when(stale(l, c), 7).otherwise(2))
        .otherwise(F.when(stale(c, l), 8).otherwise(1))
    )
    if fold_only is not None:
        code = F.when(F.coalesce(fold_only, F.lit(False)) & code.isin(5, 6), 7).otherwise(code)
    d = d.withColumn("code", code)
    scratch = c.isNotNull() & F.endswith("path", F.lit(SCRATCH_SUFFIX))
    kept = F.get(F.array(*(F.lit(_CODE[(LOCAL, o[1], CLOUD, o[1] is not None)] if o[0] == CLOUD else k) for k, o in enumerate(OUTCOMES))), F.col("code"))
    d = d.withColumn("code", F.when(scratch, kept).otherwise(F.col("code")))
    return d.select("path", B, L, C, "local_delta", "cloud_delta", *(_field(F.col("code"), k).alias(n) for k, n in enumerate(("winner", "conflict_type", "history", "publish"))))


def history(decisions: DataFrame) -> DataFrame:
    """path and version of what goes to history; one row for equal ids and paths."""
    # One use of `history`, so that the decision is not spelled out once more for each branch.
    place = F.array_position(F.array(F.lit(LOCAL), F.lit(CLOUD)), F.col("history")).cast("int") - 1
    v = F.get(F.array(L, C), place)
    return decisions.select("path", v.alias("v")).where("v IS NOT NULL").select("path", "v.*").dropDuplicates(["id", "path"])


def conflicts(decisions: DataFrame) -> DataFrame:
    """Contested paths with the losing version, null where the loser is a removal."""
    loser = F.when(F.col("winner") == CLOUD, F.col(L)).otherwise(F.col(C))
    return decisions.where("conflict_type IS NOT NULL").select("path", "winner", "conflict_type", loser.alias("copy"))


def apply_set(decisions: DataFrame) -> DataFrame:
    """What the local folder takes from the cloud: path, action, v."""
    won = decisions.where((F.col("winner") == CLOUD) & ~same_version(F.col(L), F.col(C)))
    action = F.when(F.col(C).isNull() & F.col(L).isNotNull(), REMOVE).otherwise(UPSERT)
    return won.select("path", action.alias("action"), F.coalesce(C, L).alias("v"))


def merged(decisions: DataFrame) -> DataFrame:
    """The file list after the merge."""
    v = F.when(F.col("winner") == CLOUD, F.col(C)).otherwise(F.col(L))
    return decisions.select("path", v.alias("v")).where("v IS NOT NULL").select("path", "v.*")


def cloud_ignore(decisions: DataFrame, path: str) -> DataFrame:
    """The cloud's version of the ignore file at `path`, if it has one and the local one differs or is missing: one row or none.
    Only then do its lines hold back removals."""
    return decisions.where((F.col("path") == path) & ignore_counts()).select("path", F.col(C).alias("v"))


def ignore_counts() -> Column:
    """Whether the cloud's version of a path, an ignore file, holds back removals: it is there, and the local one is not the same."""
    return F.col(C).isNotNull() & ~same_version(F.col(L), F.col(C))


def in_path_order(decisions: DataFrame, prefix: int = 14) -> DataFrame:
    """`decisions` with pos, counted from 1 by path in byte order.

    Rows are numbered among the paths with the same first `prefix` characters; counts of these add the rest, so that no task
    sorts all rows.
    """
    keyed = decisions.withColumn("__start", F.substring("path", 1, prefix))
    groups = keyed.groupBy("__start").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("__start", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))  # one row a start
    rows = keyed.withColumn("__row", F.row_number().over(Window.partitionBy("__start").orderBy("path"))).join(groups, "__start")
    return rows.withColumn("pos", F.col("__before") + F.col("__row")).select(*decisions.columns, "pos")


def spared_removes(actions: DataFrame, ignored: Column) -> DataFrame:
    """`actions` without removals of paths that the cloud's ignore rules name; upserts are not held back."""
    return actions.where((F.col("action") != REMOVE) | ~ignored)


def outcome(decisions: DataFrame, applied: DataFrame) -> DataFrame:
    """One row: whether data and local state changed, how many of each, and what becomes of the snapshot."""
    d = decisions.agg(
        F.coalesce(F.bool_or((F.col("local_delta") != UNCHANGED) | F.col("publish")), F.lit(False)).alias("local_changed"),
        F.count_if(F.col("conflict_type").isNotNull()).alias("conflicts"),
    )
    a = applied.agg(F.count_if(F.col("action") == UPSERT).alias("upserts"), F.count_if(F.col("action") == REMOVE).alias("removes"))
    changed = (F.col("upserts") + F.col("removes")) > 0
    kind = F.when(changed & F.col("local_changed"), "merge-snapshot").when(changed, "fast-forward").otherwise("keep-local")
    return d.crossJoin(a).select("upserts", "removes", "conflicts", changed.alias("data_changed"), "local_changed", kind.alias("snapshot"))


def download_plan(base: DataFrame, local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Download-only sync: the cloud always wins, by second. Conflicts are local upserts (against the last sync) that the plan
    touches by id or by path; local removals never conflict. path, action, id, conflict."""
    actions = upserts_and_removes(cloud, local).select("path", "action", F.col("v.id").alias("id"))
    own = upserts_and_removes(local, base).where("action = 'upsert'").select("path", F.col("v.id").alias("id"))
    # A union of two semi-joins: an OR between them would compare every pair.
    hit = own.join(actions.select("path"), "path", "left_semi").select("path", "id").unionByName(own.join(actions.select("id"), "id", "left_semi").select("path", "id")).distinct()
    return actions.join(hit.select("path", F.lit(True).alias("hit")), "path", "full_outer").select("path", "action", "id", F.coalesce("hit", F.lit(False)).alias("conflict"))


def fold_only_changes(local_blocks: DataFrame, base_blocks: DataFrame, view_keys: tuple[str, ...] = ("fold", "heading-fold", "updated")) -> DataFrame:
    """path, fold_only: documents whose blocks (path, block_id, kind, content, attrs) differ in view attributes alone, if at all."""
    def plain(df, side):
        attrs = F.map_filter("attrs", lambda k, _: ~k.isin(*view_keys))
        return df.select("path", "block_id", F.struct("kind", "content", F.array_sort(F.map_entries(attrs)).alias("attrs")).alias(side))

    both = plain(local_blocks, "l").join(plain(base_blocks, "b"), ["path", "block_id"], "full_outer")
    return both.groupBy("path").agg(F.bool_and(F.coalesce(F.col("l") == F.col("b"), F.lit(False))).alias("fold_only"))
