"""Versioned search, logs and paging. Results carry `pos`, so their order survives a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import basename, human_size, shown_time

PAGE_SIZE = 32


def newest_holder(snapshot_files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """id, snapshot_id: per file version, the newest snapshot that has it."""
    s = snapshots.select("snapshot_id", "created")
    return snapshot_files.select("id", "snapshot_id").join(s, "snapshot_id").groupBy("id").agg(F.max_by("snapshot_id", F.struct("created", "snapshot_id")).alias("snapshot_id"))


def newest_holder_of(intervals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The same, of versions as intervals of numbered snapshots (snap, snapshot_id): their last one, without a row a snapshot."""
    last = intervals.groupBy("id").agg((F.max("next") - 1).alias("snap"))
    return last.join(snapshots.select("snap", "snapshot_id"), "snap").select("id", "snapshot_id")


def interval_stats(intervals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """snapshot_id, count, size of snapshots that hold files, from the differences at the ends of intervals."""
    ends = F.explode(F.array(F.struct(F.col("first").alias("snap"), F.lit(1).alias("one")), F.struct(F.col("next").alias("snap"), F.lit(-1).alias("one"))))
    change = intervals.select("size", ends.alias("e")).groupBy("e.snap").agg(F.sum("e.one").alias("n"), F.sum(F.col("e.one") * F.col("size")).alias("bytes"))
    w = Window.orderBy("snap")  # one row a snapshot
    running = snapshots.select("snap", "snapshot_id").join(change, "snap", "left").select("snapshot_id", F.sum("n").over(w).alias("count"), F.sum("bytes").over(w).alias("size"))
    return running.where("count > 0")


#: How titles are stored inside attributes; the ampersand is undone last.
ESCAPES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def unescaped(attribute: Column | str) -> Column:
    """An attribute's value as it was before it was escaped."""
    out = F.col(attribute) if isinstance(attribute, str) else attribute
    for written, meant in ESCAPES:
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def keyword_match(keyword: str, document_suffix: str = ".sy", node_id: str = r"^\d{14}-[0-9a-z]{7}$") -> Column:
    """Case-insensitive part of the name; for documents, of their unescaped title, unless the keyword is a node id or the title
    is empty. Empty matches all."""
    import re

    needle = F.lower(F.lit(keyword))
    name = F.contains(F.lower(basename("path")), needle)
    if re.match(node_id, keyword):
        return name
    title = F.when(F.endswith("path", F.lit(document_suffix)) & (F.coalesce(F.length("title"), F.lit(0)) > 0), F.contains(F.lower(unescaped("title")), needle))
    return F.coalesce(title, name)


def exact_name(name: str) -> Column:
    return F.lower(basename("path")) == name.lower()


def search(files: DataFrame, holders: DataFrame, match: Column) -> DataFrame:
    """Matching file versions with the newest snapshot of each."""
    return files.where(match).join(holders, "id")


def bounds(page: int, page_size: int) -> tuple[int, int]:
    """First position and size of a page; pages count from 1, and nonsense gives the defaults."""
    page, size = max(page, 1), page_size if page_size > 0 else PAGE_SIZE
    return (page - 1) * size, size


def paged(rows: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page with `pos`: a top-k of offset + limit, then positions over the page alone."""
    start, size = bounds(page, page_size)
    part = rows.orderBy(*order).offset(start).limit(size)
    return part.withColumn("pos", F.row_number().over(Window.orderBy(*order)) + start)


def totals(rows: DataFrame, page_size: int) -> DataFrame:
    """total and pages of a result."""
    _, size = bounds(1, page_size)
    return rows.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("bigint").alias("pages"))


def newest_first(id: str = "id", time: str = "updated") -> list[Column]:
    return [F.desc(time), F.desc(id)]


def stats(snapshot_files: DataFrame) -> DataFrame:
    """snapshot_id, count, size."""
    return snapshot_files.groupBy("snapshot_id").agg(F.count("*").alias("count"), F.sum("size").alias("size"))


def log_rows(snapshots: DataFrame, counts: DataFrame, **options) -> DataFrame:
    """Log rows: a snapshot with its numbers and how they are shown. `options` are those of human_size."""
    rows = snapshots.join(counts, "snapshot_id", "left").na.fill(0, ["count", "size"])
    return rows.select("snapshot_id", "memo", "created", shown_time("created").alias("created_text"), "count", "size", human_size("size", **options).alias("size_text"))


def tag_log(refs: DataFrame, logs: DataFrame, cloud_logs: DataFrame | None = None) -> DataFrame:
    """Log rows of tags; references that aren't 40 characters are skipped. Where a tag's snapshot is not here, the cloud's row
    stands, if `cloud_logs` (with the columns of `logs`) are given."""
    tags = refs.where("kind = 'tag' AND length(snapshot_id) = 40").select(F.col("name").alias("tag"), "snapshot_id")
    here = tags.join(logs, "snapshot_id")
    if cloud_logs is None:
        return here
    return here.unionByName(tags.join(logs, "snapshot_id", "left_anti").join(cloud_logs, "snapshot_id"))


def listed_page(listed: DataFrame, snapshots: DataFrame, page: int) -> DataFrame:
    """A page of the cloud's list in list order; entries that can't be read are left out and still count in the totals."""
    start, size = bounds(page, PAGE_SIZE)
    return listed.where((F.col("ordinal") >= start) & (F.col("ordinal") < start + size)).join(snapshots, "snapshot_id")


def resolve(snapshot_files: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a snapshot in list order; `found` is false where the version is not stored."""
    known = files.select(F.col("id"), "path", "size").dropDuplicates(["id"])
    return snapshot_files.select("ordinal", "id").join(known, "id", "left").withColumn("found", F.col("path").isNotNull())
