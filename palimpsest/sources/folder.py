"""A folder as a Spark data source: path, size, updated (ms) of its regular files. Symbolic links and special files are no rows.

`spark.dataSource.register(FolderSource)`, then `spark.read.format("folder").option("root", ...).load()`. The root must be
visible to all executors. Sub-folders of the first two levels are dealt to partitions. With `tolerate` (default true),
files that vanish during the walk are left out; without it they fail the read.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size bigint, updated bigint"


class Folders(InputPartition):
    def __init__(self, deep: list[str], flat: list[str]):
        self.deep, self.flat = deep, flat


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["root"])
        self.tolerate = options.get("tolerate", "true").lower() == "true"
        self.parallel = int(options.get("partitions", "16"))

    def partitions(self) -> list[Folders]:
        flat, deep = [self.root], []
        for one in self._folders(self.root):
            flat.append(one)
            deep += self._folders(one)
        n = max(1, min(self.parallel, len(flat) + len(deep)))
        return [Folders(deep[k::n], flat[k::n]) for k in range(n)]

    def _folders(self, at: str) -> list[str]:
        return sorted(e.path for e in os.scandir(at) if e.is_dir(follow_symlinks=False))

    def read(self, partition: Folders) -> Iterator[tuple[str, int, int]]:
        for folder in partition.flat:
            for e in os.scandir(folder):
                if e.is_file(follow_symlinks=False):
                    yield from self._row(e.path)
        for folder in partition.deep:
            for at, _, names in os.walk(folder):
                for name in names:
                    yield from self._row(os.path.join(at, name))

    def _row(self, path: str) -> Iterator[tuple[str, int, int]]:
        try:
            s = os.lstat(path)
        except FileNotFoundError:
            if not self.tolerate:
                raise
            return
        if stat.S_ISREG(s.st_mode):
            yield "/" + os.path.relpath(path, self.root).replace(os.sep, "/"), s.st_size, s.st_mtime_ns // 1_000_000


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def walk(spark, root: str, tolerate: bool = True, partitions: int = 16):
    """The files under `root`."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("root", root).option("tolerate", str(tolerate)).option("partitions", str(partitions)).load()


def stored_objects(spark, root: str, prefix: str = ""):
    """path, size of a folder-backed object store, below a prefix; temporary files are not objects."""
    from pyspark.sql import functions as F

    rows = walk(spark, root).select(F.substring("path", 2, 1 << 20).alias("path"), "size").where("path NOT LIKE '%.tmp'")
    return rows.where(F.startswith("path", F.lit(prefix)))
