"""Paths on disk: built-in and user ignore rules, checkout order, repository listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalars import basename, depth

# Order in which a checkout writes, by first match.
CHECKOUT_ORDER = ("assets", "emojis", "storage", "plugins", "widgets", "templates", "public")


def built_in_ignored(path: str = "path", app_dir: str = ".app", status_file: str = "filesys_status_check", extra_suffixes: tuple[str, ...] = ()) -> Column:
    """Hidden names, scratch files, anything under a hidden folder other than the application's, and named suffixes."""
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda s: s != "")
    hidden = F.exists(folders, lambda s: (F.startswith(s, F.lit(".")) & (s != app_dir)) | (s == status_file))
    name = basename(path)
    out = hidden | F.startswith(name, F.lit(".")) | F.endswith(name, F.lit(".tmp")) | (name == status_file)
    for suffix in extra_suffixes:
        out = out | F.endswith(path, F.lit(suffix))
    return out


def compiled(lines: list[str]) -> list[tuple[str, bool]]:
    """Ignore lines as (regular expression over rooted paths, negated), in order; repeated lines once.

    Supported: comments, !, leading and trailing /, *, ?, [..], ** between slashes.
    """
    out = []
    for line in dict.fromkeys(x.rstrip() for x in lines):
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        pattern, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                pattern, i = pattern + "(?:[^/]+/)*", i + 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                pattern, i = pattern + "/.+", i + 3
            elif line[i] == "*":
                pattern, i = pattern + "[^/]*", i + 1
            elif line[i] == "?":
                pattern, i = pattern + "[^/]", i + 1
            elif line[i] == "[" and "]" in line[i + 2 :]:
                end = line.index("]", i + 2)
                inside = line[i + 1 : end]
                pattern, i = pattern + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
            else:
                pattern, i = pattern + re.escape(line[i]), i + 1
        out.append((f"^/{'' if anchored else '(?:.*/)?'}{pattern}{'/.+' if folder else '(?:/.+)?'}$", negated))
    return out


def user_ignored(lines: list[str], path: str = "path") -> Column:
    """Whether the last matching line ignores the path."""
    out = F.lit(False)
    for pattern, negated in compiled(lines):
        out = F.when(F.col(path).rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def checkout_rank(path: str = "path", app_dir: str = ".app") -> Column:
    """The application's own folder first, wherever it lies, then by top folder; others last."""
    out = F.when(F.contains(F.col(path), F.lit(app_dir)), 0)
    for k, category in enumerate(CHECKOUT_ORDER, 1):
        out = out.when(F.startswith(F.col(path), F.lit(f"/{category}/")), k)
    return out.otherwise(len(CHECKOUT_ORDER) + 1)


def checkout_order(path: str = "path", app_dir: str = ".app") -> list[Column]:
    return [checkout_rank(path, app_dir), depth(path), F.col(path)]


def checkout_positions(files: DataFrame, app_dir: str = ".app", prefix: int = 14) -> DataFrame:
    """`files` (path, each once) with rank, depth and pos, counted from 1 over all files.

    Rows are numbered among the paths of a rank, depth and first `prefix` characters; counts of these groups add the rest,
    so that no task sorts all files, nor all of a rank.
    """
    keyed = files.withColumn("rank", checkout_rank("path", app_dir)).withColumn("depth", depth("path")).withColumn("__start", F.substring("path", 1, prefix))
    level, group = ["rank", "depth"], ["rank", "depth", "__start"]
    groups = keyed.groupBy(*group).agg(F.count("*").alias("__n"))
    levels = groups.groupBy(*level).agg(F.sum("__n").alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.select(*level, before(Window.orderBy(*level)).alias("__level"))  # one row a rank and depth
    groups = groups.withColumn("__group", before(Window.partitionBy(*level).orderBy("__start"))).join(levels, level)
    rows = keyed.withColumn("__row", F.row_number().over(Window.partitionBy(*group).orderBy("path"))).join(groups.drop("__n"), group)
    return rows.withColumn("pos", F.col("__level") + F.col("__group") + F.col("__row")).select(*files.columns, "rank", "depth", "pos")


def listing(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects under a prefix."""
    return objects.where(F.startswith("path", F.lit(prefix)))


def repositories(objects: DataFrame) -> DataFrame:
    """name, size, updated, objects of each repository of a store (repo, path, size, updated)."""
    return objects.groupBy(F.col("repo").alias("name")).agg(F.sum("size").alias("size"), F.max("updated").alias("updated"), F.count("*").alias("objects"))
