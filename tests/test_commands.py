"""Folder source, ignore rules, and the commands of a repository."""

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunks, folders
from palimpsest.sources.folder import walk
from palimpsest.sources.repository import EmptySnapshot, NoSuchSnapshot, Repository, renamed
from palimpsest.streaming.jobs import index_on_change, session_stream

T0 = 1_700_000_000


def put(root, path, content, minutes=0):
    p = f"{root}/{path}"
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(content)
    os.utime(p, (T0 + 60 * minutes,) * 2)


def contents(root):
    return {os.path.relpath(f"{at}/{n}", root): open(f"{at}/{n}", "rb").read() for at, _, names in os.walk(root) for n in names}


def test_walk_keeps_underscores_and_skips_links(spark, tmp_path):
    put(tmp_path, "a/_x.txt", b"1")
    put(tmp_path, "top.txt", b"22")
    put(tmp_path, "a/b/c/d.txt", b"")
    os.symlink(tmp_path / "top.txt", tmp_path / "link")
    rows = {r.path: (r.size, r.updated) for r in walk(spark, str(tmp_path), partitions=3).collect()}
    assert rows == {"/a/_x.txt": (1, T0 * 1000), "/top.txt": (2, T0 * 1000), "/a/b/c/d.txt": (0, T0 * 1000)}


@pytest.mark.parametrize(
    ("path", "ignored"),
    [("/a/.x", True), ("/.git/a", True), ("/.app/a.json", False), ("/.app/.b/a", True), ("/a.tmp", True), ("/a/b.txt", False), ("/filesys_status_check/x", True)],
)
def test_built_in_rules(spark, path, ignored):
    assert spark.createDataFrame([(path,)], "path string").select(folders.built_in_ignored()).first()[0] is ignored


@pytest.mark.parametrize(
    ("lines", "path", "ignored"),
    [
        (["foo"], "/a/foo/b", True), (["/foo"], "/a/foo", False), (["foo/"], "/foo", False), (["foo/"], "/foo/x", True), (["*.md", "!keep.md"], "/a/keep.md", False), (["*.md", "!keep.md"], "/a/x.md", True),
        (["a/**/z"], "/a/b/c/z", True), (["a/**/z"], "/a/z", True), (["a/*"], "/a/b", True), (["x?z"], "/xyz", True), (["x[ab]"], "/xc", False), (["x[!ab]"], "/xc", True), (["# c", ""], "/c", False),
    ],
)
def test_user_rules(spark, lines, path, ignored):
    assert spark.createDataFrame([(path,)], "path string").select(folders.user_ignored(lines)).first()[0] is ignored


def test_index_checkout_tags_purge(spark, tmp_path):
    data, tables = tmp_path / "data", tmp_path / "tables"
    data.mkdir()
    repo = Repository(spark, str(tables), str(data), ignore=["skip.txt"], least=64, most=512, bits=6)
    with pytest.raises(EmptySnapshot):
        repo.index("none", 1)
    put(data, "a.txt", os.urandom(3000))
    put(data, "b/c.txt", b"")
    put(data, "skip.txt", b"no")
    first = repo.index("one", 1000)
    assert repo.index("again", 2000) == first == repo.latest()
    old = contents(data)
    put(data, "a.txt", old["a.txt"] + b"more", 1)
    os.unlink(data / "b/c.txt")
    put(data, "d.txt", b"new", 2)
    second = repo.index("two", 3000)
    assert second != first
    assert {r.path for r in repo.files_of(second).collect()} == {"/a.txt", "/d.txt"}
    new = contents(data)
    assert repo.checkout(first) == (2, 1)
    assert contents(data) == old
    repo.checkout(second)
    assert contents(data) == new
    repo.add_tag("v1", second, 4000)
    with pytest.raises(NoSuchSnapshot):
        repo.add_tag("v2", "0" * 40, 4000)
    with pytest.raises(ValueError):
        repo.add_tag("a/b", second, 4000)
    # Most of the old text's chunks live on in the new one.
    assert repo.table("chunks").count() < 2 * len(list(chunks.Roller(64, 512, 6).cuts(old["a.txt"])))
    stat = repo.purge()
    assert (stat.snapshots, repo.purge().objects) == (1, 0)
    repo.checkout(second)
    assert contents(data) == new
    repo.remove_tag("v1")
    assert repo.ref("v1") is None
    with pytest.raises(ValueError):
        repo.reset()
    repo.reset(confirm=True)
    assert repo.ref("latest") is None


class Died(Exception):
    pass


@pytest.fixture
def small(spark, tmp_path):
    """A repository with three snapshots, the first two without references."""
    data = tmp_path / "data"
    put(data, "a.txt", os.urandom(2000))
    repo = Repository(spark, str(tmp_path / "tables"), str(data), least=64, most=512, bits=6)
    ids = [repo.index("one", 1000)]
    for k in (1, 2):
        put(data, "a.txt", os.urandom(2000), k)
        ids.append(repo.index(f"snapshot {k}", 1000 * k))
    return repo, data, ids


def test_a_purge_that_dies_loses_nothing(small, monkeypatch):
    """Stop after each table and before the switch: all snapshots are still there, and the next purge does the whole work."""
    repo, data, ids = small
    before = {n: repo.table(n).count() for n in ("snapshots", "snapshot_files", "files", "chunks")}
    whole = contents(data)
    path = Repository._path
    for stop in ("snapshot_files", "files", "chunks", None):
        def dies(self, name, version=None, stop=stop):
            if version and name == stop:
                raise Died
            return path(self, name, version)

        with monkeypatch.context() as m:
            m.setattr(Repository, "_path", dies)
            if stop is None:
                m.setattr(Repository, "_switch", lambda *a: (_ for _ in ()).throw(Died()))
            with pytest.raises(Died):
                repo.purge()
        assert {n: repo.table(n).count() for n in before} == before
    # Dead after the switch, before the old version is deleted.
    delete = Repository._delete
    with monkeypatch.context() as m:
        m.setattr(Repository, "_delete", lambda *a: (_ for _ in ()).throw(Died()))
        with pytest.raises(Died):
            repo.purge()
    assert delete is Repository._delete
    assert [r.snapshot_id for r in repo.table("snapshots").collect()] == [ids[2]]
    assert repo.purge().snapshots == 0
    assert len(os.listdir(f"{repo.tables}/versions")) == 1
    put(data, "a.txt", b"other", 9)
    repo.checkout(ids[2])
    assert contents(data) == whole


def test_a_reference_that_dies_is_old_or_new(small, monkeypatch):
    repo, _, ids = small
    repo.add_tag("v", ids[0], 1)
    with monkeypatch.context() as m:
        m.setattr(Repository, "_delete", lambda *a: (_ for _ in ()).throw(Died()))
        with pytest.raises(Died):
            repo.add_tag("v", ids[1], 2)
    assert repo.ref("v") == ids[1]  # the new row is there and outnumbers the old one, which was not deleted
    repo.add_tag("v", ids[0], 0)
    assert repo.ref("v") == ids[0]
    repo.remove_tag("v")
    assert repo.ref("v") is None and repo.ref("latest") == ids[2]
    repo.add_tag("v", ids[2], 5)
    assert repo.ref("v") == ids[2]


def test_an_index_that_dies_leaves_the_latest(small, monkeypatch):
    repo, data, ids = small
    put(data, "b.txt", b"new", 7)
    for step in ("set_ref", "append"):
        with monkeypatch.context() as m:
            m.setattr(Repository, step, lambda *a, **b: (_ for _ in ()).throw(Died()))
            with pytest.raises(Died):
                repo.index("dies", 9000)
        assert repo.latest() == ids[2] and {r.path for r in repo.latest_files().collect()} == {"/a.txt"}
    assert repo.index("lives", 9001) == repo.latest() != ids[2]
    assert {r.path for r in repo.latest_files().collect()} == {"/a.txt", "/b.txt"}
    assert [n for n in os.listdir(f"{repo.tables}/full-latest")] == [repo.latest()]
    assert not [n for n in os.listdir(repo.tables) if n.startswith("staging")]


def test_index_starts_again_when_a_file_changes(small, monkeypatch):
    """A file that changes between the walk and the read: a new walk sees it; seven tries at most."""
    repo, data, ids = small
    put(data, "a.txt", b"first", 20)
    store, tries = Repository._store, []

    def late(self, upserts):
        tries.append(1)
        if len(tries) < 3:
            put(data, "a.txt", b"grows" * len(tries), 20 + len(tries))
        store(self, upserts)

    monkeypatch.setattr(Repository, "_store", late)
    snapshot = repo.index("late", 1)
    assert len(tries) == 3 and repo.files_of(snapshot).first().size == 10
    tries.clear()

    def never(self, upserts):
        tries.append(1)
        put(data, "a.txt", b"x" * (20 + len(tries)), 30 + len(tries))
        store(self, upserts)

    monkeypatch.setattr(Repository, "_store", never)
    put(data, "a.txt", b"x", 29)
    with pytest.raises(Exception, match="changed while it was read"):
        repo.index("never", 2)
    assert len(tries) == 7 and repo.latest() == snapshot


def test_renames_are_tried_three_times():
    done = []

    def rename(old, new, fails):
        done.append((old, new))
        if len(done) <= fails:
            raise PermissionError

    for fails, n in ((0, 1), (2, 3)):
        done.clear()
        renamed("a", "b", pause=0, rename=lambda o, w, fails=fails: rename(o, w, fails))
        assert len(done) == n
    done.clear()
    with pytest.raises(PermissionError):
        renamed("a", "b", pause=0, rename=lambda o, w: rename(o, w, 9))
    assert len(done) == 3


def test_checkout_writes_one_kind_of_folder_after_the_other(spark, tmp_path):
    """Modification order on disk follows the checkout order, between kinds and, in one task, by depth."""
    data = tmp_path / "data"
    paths = ["z/deep/er/x.txt", "assets/b/c.txt", "assets/a.txt", ".app/conf.json", "public/p.txt", "top.txt", "notes/assets/n.txt"]
    for p in paths:
        put(data, p, p.encode())
    repo = Repository(spark, str(tmp_path / "tables"), str(data))
    snapshot = repo.index("all", 1)
    for p in paths:
        os.unlink(data / p)
    assert repo.checkout(snapshot) == (len(paths), 0)
    made = {p: os.stat(data / p).st_ctime_ns for p in paths}
    kinds = [[".app/conf.json"], ["assets/a.txt", "assets/b/c.txt"], ["public/p.txt"], ["top.txt", "notes/assets/n.txt", "z/deep/er/x.txt"]]
    for earlier, later in zip(kinds, kinds[1:], strict=False):
        assert max(made[p] for p in earlier) < min(made[p] for p in later)


def test_feed_indexes_and_sessions_close(spark, tmp_path):
    data, tables, feed = tmp_path / "data", tmp_path / "tables", tmp_path / "feed"
    put(data, "a.txt", b"x")
    spark.createDataFrame([("k", f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 30)], "key string, ts string").select("key", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(feed))
    repo = Repository(spark, str(tables), str(data))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(feed))
    index_on_change(stream, repo, str(tmp_path / "cp"), lambda n: 1000 + n).awaitTermination(60)
    assert repo.table("snapshots").count() == 1
    q = session_stream(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.uses for r in spark.table("closed").collect()] == [2]


def remainder(data, polynomial):
    """Of a byte string as a polynomial over GF(2), bit by bit."""
    rest, degree = 0, polynomial.bit_length() - 1
    for byte in data:
        for k in range(7, -1, -1):
            rest = rest << 1 | (byte >> k & 1)
            if rest >> degree:
                rest ^= polynomial
    return rest


def test_cuts_against_the_rule():
    """Cuts are where the remainder of the last 64 bytes ends in zero bits, at least and at most so far from the last one."""
    data = os.urandom(6000) + b"\0" * 700 + os.urandom(3000)
    for least, most, bits in ((64, 512, 6), (100, 1000, 5), (64, 64, 3)):
        want, start = [], 0
        while start < len(data):
            end = next((e for e in range(start + least, min(start + most, len(data))) if remainder(data[e - 64 : e], chunks.POLYNOMIAL) % (1 << bits) == 0), min(start + most, len(data)))
            want.append(end)
            start = end
        assert list(chunks.Roller(least, most, bits).cuts(data)) == want
    with pytest.raises(ValueError):
        chunks.Roller(63, 512, 6)


def test_a_large_file_is_cut_in_bounded_memory():
    import tracemalloc

    roller, block = chunks.Roller(), os.urandom(1 << 20)
    left = [64]

    def read(n):
        left[0] -= 1
        return block if left[0] >= 0 else b""

    tracemalloc.start()
    total = sum(len(p) for p in roller.pieces(read))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert total == 64 << 20 and peak < 48 << 20


def test_rolling_cuts():
    data = os.urandom(60_000)
    roller = chunks.Roller(512, 4096, 10)
    cuts = list(roller.cuts(data))
    sizes = [b - a for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
    assert cuts[-1] == len(data)
    assert all(512 <= s <= 4096 for s in sizes[:-1])
    assert list(roller.cuts(b"")) == [0]
    # An insertion near the front moves few chunks.
    whole = {data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)}
    other = data[:1000] + b"inserted" + data[1000:]
    moved = list(roller.cuts(other))
    assert sum(other[a:b] not in whole for a, b in zip([0, *moved[:-1]], moved, strict=True)) <= 4


def test_objects_of_a_store(spark, tmp_path):
    from palimpsest.sources import objects

    for k in ("objects/ab/cd01", "objects/ab/ef02", "objects/b0/aa03", "indexes/x", "objects/ab/half.tmp"):
        put(tmp_path / "store", k, k.encode())
    for root in (f"file://{tmp_path}/store", f"{tmp_path}/store/"):
        rows = {r.path: (r.size, r.updated) for r in objects.listing(spark, root).collect()}
        assert rows == {k: (len(k), T0 * 1000) for k in ("objects/ab/cd01", "objects/ab/ef02", "objects/b0/aa03", "indexes/x")}
        assert {r.path for r in objects.listing(spark, root, "objects/ab/c").collect()} == {"objects/ab/cd01"}
        assert {r.path: bytes(r.data) for r in objects.contents(spark, root, "indexes/").collect()} == {"indexes/x": b"indexes/x"}
    plan = objects.listing(spark, str(tmp_path / "store"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_rooted_paths(spark):
    from palimpsest.functions import scalars as S

    rows = [("/data/a/b.txt", "/a/b.txt"), ("/data/", "/"), ("\\data\\a\\b", "/a/b"), ("other/x", "/other/x"), ("//y", "/y"), (None, None)]
    df = spark.createDataFrame(rows, "path string, want string").withColumn("got", S.rooted("path", "/data"))
    assert [r.got for r in df.collect()] == [w for _, w in rows]
