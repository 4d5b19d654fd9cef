"""A repository: Parquet tables of snapshots, files and chunks, named references, and the commands on them.

Commands run actions; everything a result depends on (clock, ids) is an argument. One command at a time may write.

A command may die at any point. Data is written before the reference that names it, which leaves unreferenced rows at worst.
Snapshots, files and chunks lie in a folder of their own for each version of the tables, and the highest numbered file in
`current` names the one that counts: a purge writes a whole new version, then that file, then deletes the old one. A
reference is a row with a number; the highest number of a name counts, and older rows go after the new one is there.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import chunks, diff, folders, reach

from .folder import walk

SCHEMAS = {
    "snapshots": "snapshot_id string, memo string, created bigint, count bigint, size bigint",
    "snapshot_files": "snapshot_id string, id string",
    "files": "id string, path string, size bigint, updated bigint, chunks array<string>",
    "chunks": "chunk_id string, data binary, size bigint",
    "refs": "name string, kind string, snapshot_id string, updated bigint",
    "history": "path string, id string, at bigint",
}
VERSIONED = ("snapshots", "snapshot_files", "files", "chunks")
NUMBERED_REFS = SCHEMAS["refs"] + ", number bigint"
INDEX_TRIES, RENAME_TRIES, RENAME_PAUSE_S = 7, 3, 0.2
CHANGED = "changed while it was read"


class EmptySnapshot(Exception):
    """Nothing to index."""


class NoSuchSnapshot(Exception):
    pass


def renamed(old: str, new: str, tries: int = RENAME_TRIES, pause: float = RENAME_PAUSE_S, rename=os.replace) -> None:
    """Put a finished file in its place; one that another program holds open just now is tried again."""
    for left in reversed(range(tries)):
        try:
            return rename(old, new)
        except PermissionError:
            if not left:
                raise
            time.sleep(pause)


class Repository:
    def __init__(self, spark: SparkSession, tables: str, data: str, ignore: list[str] | None = None, least: int = chunks.LEAST, most: int = chunks.MOST, bits: int = chunks.BITS):
        self.spark, self.tables, self.data, self.ignore = spark, tables.rstrip("/"), data, ignore or []
        self.least, self.most, self.bits = least, most, bits

    # Folders and tables

    def _store_of(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, store = self._store_of(path)
        return store.exists(p)

    def _delete(self, path: str) -> None:
        p, store = self._store_of(path)
        store.delete(p, True)

    def _names(self, path: str) -> list[str]:
        p, store = self._store_of(path)
        return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []

    def _version(self) -> str:
        """The folder of the tables that count."""
        switches = [n for n in self._names(f"{self.tables}/current") if "-" in n]
        return max(switches) if switches else "000000000000-first"

    def _new_version(self) -> str:
        return f"{int(self._version().split('-')[0]) + 1:012d}-{uuid.uuid4().hex}"

    def _switch(self, version: str) -> None:
        """From here on `version` counts: one empty file, made or not made. What no longer counts goes afterwards."""
        p, store = self._store_of(f"{self.tables}/current/{version}")
        store.create(p, False).close()
        for name in self._names(f"{self.tables}/current"):
            if name < version:
                self._delete(f"{self.tables}/current/{name}")
        for name in self._names(f"{self.tables}/versions"):
            if name != version:
                self._delete(f"{self.tables}/versions/{name}")

    def _path(self, name: str, version: str | None = None) -> str:
        return f"{self.tables}/versions/{version or self._version()}/{name}" if name in VERSIONED else f"{self.tables}/{name}"

    def _read(self, path: str, schema: str) -> DataFrame:
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def table(self, name: str) -> DataFrame:
        if name != "refs":
            return self._read(self._path(name), SCHEMAS[name])
        newest = self._read(self._path("refs"), NUMBERED_REFS).groupBy("kind", "name").agg(F.max_by(F.struct("snapshot_id", "updated"), "number").alias("r"))
        return newest.where("r.snapshot_id IS NOT NULL").select("name", "kind", "r.snapshot_id", "r.updated")

    def append(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """Append rows; with `key`, those whose key is not there yet, each once."""
        if key:
            rows = rows.dropDuplicates([key]).join(self.table(name).select(key), key, "left_anti")
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.select(columns).write.mode("append").parquet(self._path(name))

    # References

    def set_ref(self, name: str, kind: str, snapshot_id: str, now: int) -> None:
        if kind == "tag" and not self.spark.range(1).select(S.valid_tag_name(F.lit(name))).first()[0]:
            raise ValueError(f"not a tag name: {name!r}")
        if self.table("snapshots").where(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise NoSuchSnapshot(snapshot_id)
        self._put_ref(name, kind, snapshot_id, now)

    def _put_ref(self, name: str, kind: str, snapshot_id: str | None, now: int) -> None:
        """A row that outnumbers the name's rows so far; no snapshot id takes the name away."""
        folder = f"{self._path('refs')}/{kind}-{name}"
        before = self._names(folder)
        number = (self._read(folder, NUMBERED_REFS).agg(F.max("number")).first()[0] or 0) + 1
        self.spark.createDataFrame([(name, kind, snapshot_id, now, number)], NUMBERED_REFS).coalesce(1).write.mode("append").parquet(folder)
        for old in before:
            self._delete(f"{folder}/{old}")

    def ref(self, name: str) -> str | None:
        """The snapshot id that a name stands for; blank and missing ones stand for none."""
        row = self.table("refs").where(F.col("name") == name).first()
        return (row.snapshot_id or "").strip() or None if row else None

    def latest(self) -> str:
        found = self.ref("latest")
        if not found:
            raise NoSuchSnapshot("latest")
        return found

    def add_tag(self, name: str, snapshot_id: str, now: int) -> None:
        self.set_ref(name, "tag", snapshot_id, now)

    def remove_tag(self, name: str) -> None:
        self._put_ref(name, "tag", None, 0)

    def set_latest_sync(self, snapshot_id: str, now: int) -> None:
        self.set_ref("latest-sync", "ref", snapshot_id, now)

    # Snapshots

    def files_of(self, snapshot_id: str | None) -> DataFrame:
        """id, path, size, updated, chunks of a snapshot; none for no snapshot."""
        return self.table("files").join(self.table("snapshot_files").where(F.col("snapshot_id") == snapshot_id).select("id"), "id", "left_semi")

    def latest_files(self) -> DataFrame:
        """The files of the latest snapshot: from the table kept for it, or, where that is not complete, as `files_of`."""
        latest = self.ref("latest")
        kept = f"{self.tables}/full-latest/{latest}"
        if latest and self._exists(f"{kept}/_SUCCESS"):
            return self.spark.read.schema(SCHEMAS["files"]).parquet(kept)
        return self.files_of(latest)

    def _set_latest(self, snapshot: str, now: int) -> None:
        """The denormalised table first, then the reference; tables of older snapshots go last."""
        folder = f"{self.tables}/full-latest"
        self.files_of(snapshot).write.mode("overwrite").parquet(f"{folder}/{snapshot}")
        self.set_ref("latest", "ref", snapshot, now)
        for name in self._names(folder):
            if name != snapshot:
                self._delete(f"{folder}/{name}")

    def on_disk(self, tolerate: bool = True) -> DataFrame:
        rows = walk(self.spark, self.data, tolerate)
        return rows.where(~folders.built_in_ignored() & ~folders.user_ignored(self.ignore)).withColumn("id", S.file_id("path", "updated"))

    def index(self, memo: str, now: int, new_id: str | None = None) -> str:
        """The id of a snapshot of the data folder; the latest one's if nothing changed. Content is read for changed files only.
        Where a file changes while it is read, all starts again with a new walk, seven times at most."""
        for left in reversed(range(INDEX_TRIES)):
            try:
                return self._index(memo, now, new_id)
            except Exception as e:  # a task's error arrives as one of several classes, with its text
                if CHANGED not in str(e) or not left:
                    raise

    def _index(self, memo: str, now: int, new_id: str | None) -> str:
        disk = self.on_disk().persist()
        held = [disk]
        try:
            if disk.isEmpty():
                raise EmptySnapshot(self.data)
            latest = self.ref("latest")
            known = self.latest_files()
            none = F.lit(None).cast("array<string>").alias("chunks")
            changes = diff.upserts_and_removes(disk.select("path", "id", "size", "updated", none), known.select("path", "id", "size", "updated", "chunks")).persist()
            held.append(changes)
            if latest and changes.isEmpty():
                return latest
            upserts = changes.where("action = 'upsert'").select("path", "v.id", "v.size", "v.updated")
            self._store(upserts)
            snapshot = new_id or hashlib.sha1(uuid.uuid4().bytes).hexdigest()
            files = disk.select(F.lit(snapshot).alias("snapshot_id"), "id", "size")
            total = files.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
            self.append("snapshot_files", files)
            self.append("snapshots", self.spark.createDataFrame([(snapshot, memo, now, total.n, total.size)], SCHEMAS["snapshots"]))
            self._set_latest(snapshot, now)
            return snapshot
        finally:
            for df in held:
                df.unpersist()

    def _store(self, upserts: DataFrame) -> None:
        """Chunk changed files and write what is new: chunks, then file versions. A file that changes meanwhile is an error."""
        import pyarrow as pa

        root, roller = self.data, chunks.Roller(self.least, self.most, self.bits)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["id", "path", "size", "updated", "chunk_id", "data"]

        def read(batches):
            for batch in batches:
                for path, id, size, updated in zip(*(batch.column(c).to_pylist() for c in ("path", "id", "size", "updated")), strict=True):
                    out, n = [], 0
                    with open(root + path, "rb") as f:
                        for piece in roller.pieces(f.read):
                            out.append((id, path, size, updated, hashlib.sha1(piece).hexdigest(), piece))
                            n += len(piece)
                            if n >= roller.most:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                                out, n = [], 0
                    s = os.stat(root + path)
                    if s.st_size != size or s.st_mtime_ns // 1_000_000_000 != updated // 1000:
                        raise OSError(f"{CHANGED}: {path}")
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        pieces = upserts.mapInArrow(read, "id string, path string, size bigint, updated bigint, chunk_id string, data binary")
        # One pass over the disk: pieces land in a staging table, from which chunks and file versions are taken.
        staged = f"{self.tables}/staging-{uuid.uuid4().hex}"
        try:
            pieces.withColumn("pos", F.monotonically_increasing_id()).write.parquet(staged)
            pieces = self.spark.read.parquet(staged)
            self.append("chunks", pieces.select("chunk_id", "data", F.octet_length("data").cast("bigint").alias("size")), "chunk_id")
            ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"])
            self.append("files", pieces.groupBy("id", "path", "size", "updated").agg(ordered.alias("chunks")), "id")
        finally:
            self._delete(staged)

    def checkout(self, snapshot_id: str) -> tuple[int, int]:
        """Make the data folder like a snapshot: write what differs, remove what it lacks. Counts of both.

        One kind of folder after the other is written, the application's own first; within a task, shallow files come first.
        """
        want = self.files_of(snapshot_id)
        none = F.lit(None).cast("array<string>").alias("chunks")
        plan = diff.upserts_and_removes(want, self.on_disk(False).select("path", "id", "size", "updated", none)).withColumn("rank", folders.checkout_rank()).persist()
        rows = plan.where("action = 'upsert'").select("rank", S.depth("path").alias("depth"), "path", "v.updated", F.posexplode("v.chunks").alias("pos", "chunk_id"))
        writes = rows.join(self.table("chunks"), "chunk_id", "left")
        root = self.data

        def write(batches):
            import pyarrow as pa

            n, path, f, updated = 0, None, None, 0

            def close():
                f.flush()
                os.fsync(f.fileno())
                f.close()
                renamed(f.name, root + path)
                os.utime(root + path, ns=(updated * 1_000_000, updated * 1_000_000))

            for batch in batches:
                for p, u, data in zip(batch.column("path").to_pylist(), batch.column("updated").to_pylist(), batch.column("data"), strict=True):
                    if p != path:
                        if f:
                            close()
                        path, updated, n = p, u, n + 1
                        os.makedirs(os.path.dirname(root + p), exist_ok=True)
                        f = open(f"{root + p}.{uuid.uuid4().hex}.tmp", "wb")  # noqa: SIM115
                    if not data.is_valid:
                        f.close()
                        os.unlink(f.name)
                        raise FileNotFoundError(f"a chunk of {p} is not stored")
                    f.write(data.as_buffer())
            if f:
                close()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        def remove(batches):
            import pyarrow as pa

            n = 0
            for batch in batches:
                for p in batch.column("path").to_pylist():
                    if os.path.exists(root + p):
                        os.unlink(root + p)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        order, counts = ("depth", "path", "pos"), [0, 0]
        for rank in sorted(r["rank"] for r in plan.where("action = 'upsert'").select("rank").distinct().collect()):  # nine at most
            some = writes.where(F.col("rank") == rank).repartition("path").sortWithinPartitions(*order)
            counts[0] += some.select("path", "updated", "data").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
        counts[1] = plan.where("action = 'remove'").select("path").mapInArrow(remove, "n bigint").agg(F.sum("n")).first()[0] or 0
        plan.unpersist()
        return counts[0], counts[1]

    def keep_history(self, versions: DataFrame, now: int) -> None:
        """Remember versions (path, id) that a sync is about to replace."""
        self.append("history", versions.select("path", "id", F.lit(now).cast("bigint").alias("at")))

    def purge(self, retained: DataFrame | None = None):
        """Drop unreferenced snapshots and unreachable files and chunks; the counts as a row (snapshots, objects, bytes)."""
        kept = reach.referenced(self.table("refs"), retained).persist()
        files = self.table("files").join(self.table("snapshot_files"), "id").select("snapshot_id", "id", "chunks")
        live = reach.reachable(files, kept).persist()
        objects = self.table("files").select(F.col("id").alias("object_id"), "size").unionByName(self.table("chunks").select(F.col("chunk_id").alias("object_id"), "size"))
        stat = reach.purge_stat(reach.unreferenced_snapshots(self.table("snapshots"), kept), reach.garbage(objects, live)).first()
        ids = live.select("object_id").distinct()
        version = self._new_version()
        for name, rows in (
            ("snapshots", self.table("snapshots").join(kept, "snapshot_id", "left_semi")),
            ("snapshot_files", self.table("snapshot_files").join(kept, "snapshot_id", "left_semi")),
            ("files", self.table("files").join(ids, F.col("id") == ids.object_id, "left_semi")),
            ("chunks", self.table("chunks").join(ids, F.col("chunk_id") == ids.object_id, "left_semi")),
        ):
            rows.write.parquet(self._path(name, version))
        kept.unpersist()
        live.unpersist()
        self._switch(version)
        return stat

    def reset(self, confirm: bool = False) -> None:
        """Drop all tables. Only with `confirm`. References go first, so that none is left without its snapshot."""
        if not confirm:
            raise ValueError("reset() deletes the repository; pass confirm=True")
        for name in ("refs", "full-latest", "history"):
            self._delete(f"{self.tables}/{name}")
        self._switch(self._new_version())
