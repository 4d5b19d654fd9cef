"""Every query with SQL against DuckDB, on the smallest tables; properties of diff, merge and purge."""

import hashlib
import os
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diff, merge, transfer
from palimpsest.plans import fixtures, merging, registry, storage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def shown(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = sorted((tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    r = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert sorted((tuple(shown(x[i]) for i in at) for x in r.fetchall()), key=repr) == rows


@pytest.mark.parametrize("name", ["snapshot_log", "tag_log"])
def test_logs_of_large_snapshots_against_sql(spark, tmp_path, name):
    """Snapshots of more than a megabyte."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (event_type || repeat('v', 20000) AS event_type) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    r = c.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(x) for x in df.columns]
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
    assert max(x[df.columns.index("n_bytes")] for x in want) > 1_000_000
    assert sorted(map(tuple, df.collect()), key=repr) == want


def decide(b, l, c):
    """The merge rules, row by row: versions are None or (content, updated)."""

    def delta(x):
        if b is None or x is None:
            return "unchanged" if b is x else "upsert" if b is None else "remove"
        return "upsert" if b[0] != x[0] else "metadata-only" if b[1] // 1000 != x[1] // 1000 else "unchanged"

    def old(x, y):
        return x is not None and y is not None and x[1] < y[1] - 420_000

    dl, dc = delta(l), delta(c)
    ll, cc = dl in ("upsert", "remove"), dc in ("upsert", "remove")
    if (l is None and c is None) or (l and c and l[0] == c[0]) or not (ll or cc):
        if (dl == dc == "unchanged") or (l is None and c is None):
            return "none", None, None, False
        name = lambda v: f"{v[0]}{v[1] - 1_700_000_000_000}"
        cloud = c is not None and (l is None or c[1] > l[1] or (c[1] == l[1] and name(c) > name(l)))
        return ("cloud", None, None, False) if cloud else ("local", None, None, True)
    if ll and cc:
        if l is None:
            return "local", "local-remove-cloud-upsert", "cloud", True
        if c is None:
            return "local", "local-upsert-cloud-remove", "local", True
        return ("cloud", "local-upsert-cloud-upsert", "local", False) if old(l, c) else ("local", "local-upsert-cloud-upsert", "cloud", True)
    if ll:
        return ("cloud", None, "local", False) if old(l, c) else ("local", None, None, True)
    return ("local", None, "cloud", True) if old(c, l) else ("cloud", None, None, False)


def test_merge_decisions_against_rules(spark):
    got = {r.path: (r.winner, r.conflict_type, r.history, r.publish) for r in merging.merge_decision_truth(spark, SF).collect()}
    at = lambda s: None if s is None else (s[0], 1_700_000_000_000 + s[1])
    want = {f"/case{n}.txt": decide(at(b), at(l), at(c)) for n, (b, l, c) in enumerate(product(merging.STATES, repeat=3))}
    assert got == want


def test_stale_boundary(spark):
    v = "struct<id: string, size: bigint, updated: bigint, chunks: array<string>>"
    from palimpsest.functions.versions import stale

    rows = [(("a", 1, 0, ["x"]), ("b", 1, ms, ["y"])) for ms in (420_000, 420_001)] + [(None, ("b", 1, 0, ["y"]))]
    assert [r[0] for r in spark.createDataFrame(rows, f"a {v}, b {v}").select(stale(F.col("a"), F.col("b"))).collect()] == [False, True, False]


def test_diff_properties(spark):
    a, b = (fixtures.state(spark, SF, d) for d in (20, 15))
    assert diff.snapshot_diff(a, a).isEmpty()
    kinds = lambda x, y: {r.change_kind: r["count"] for r in diff.compared(x, y).groupBy("change_kind").count().collect()}
    there, back = kinds(a, b), kinds(b, a)
    assert (there.get("add"), there.get("remove"), there.get("update")) == (back.get("remove"), back.get("add"), back.get("update"))


def test_merge_of_equal_sides_has_no_conflict(spark):
    base, local, _ = (diff.as_of(fixtures.log(spark, SF), c) for c in fixtures.side_conditions())
    assert merge.conflicts(merge.decided(merge.sides(base, local, local))).isEmpty()


def test_both_ways_to_make_sides_agree(spark):
    conditions = fixtures.side_conditions()
    log = fixtures.log(spark, SF)
    one = merge.sides_of_log(log, *conditions)
    two = merge.sides(*(diff.as_of(log, c) for c in conditions))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_last_of_repeated_paths_stands(spark):
    rows = spark.createDataFrame([("/a", "1", 0), ("/a", "2", 1), ("/b", "3", 2)], "path string, id string, ordinal int")
    assert {(r.path, r.id) for r in diff.last_per_path(rows).collect()} == {("/a", "2"), ("/b", "3")}


def test_fold_only_change_wins_for_the_cloud(spark):
    rows = merging._truth(spark).where("base.id = 'x0' AND local.id = 'y60000' AND cloud.id = 'z480000'")
    plain = merge.decided(rows).first()
    folded = merge.decided(rows, fold_only=F.lit(True)).first()
    assert (plain.conflict_type, folded.conflict_type) == ("local-upsert-cloud-upsert", None)
    assert (folded.winner, folded.history, folded.publish) == ("cloud", "local", False)


def test_purge_again_finds_nothing(spark):
    dead = storage.purge_plan(spark, SF).select("object_id")
    left = storage.objects(spark, SF).join(dead, "object_id", "left_anti")
    from palimpsest.operators.reach import garbage

    assert garbage(left, storage.reachable_objects(spark, SF)).isEmpty()


def test_sequence_zero_never_wins(spark):
    assert transfer.sequence_latest(spark.createDataFrame([(0, "a")], "seq int, snapshot_id string")).isEmpty()


def test_validity_of_every_id(spark):
    rows = registry.QUERIES["id_and_name_validity_all"](spark, SF).where("kind = 'id'")
    n = fixtures.log(spark, SF).count()
    good = fixtures.log(spark, SF).where("event_id % 4 = 0").count()
    assert n > 50 and rows.count() == n and rows.where("ok").count() == good


def test_checkout_order_of_every_file(spark):
    """All of a snapshot's files; and paths at several depths, some alike in their first characters, one of other letters."""
    assert registry.QUERIES["checkout_order_all"](spark, SF).count() == fixtures.state(spark, SF, 20).count() > 50
    from palimpsest.operators import folders

    paths = [f"/{c}/{m}{k}" for c in ("assets", "emojis", "notes", "x/.app", "notes/emojis/a-long-folder-name") for m in ("", "é", "u/", "u-") for k in range(9)]
    rows = folders.checkout_positions(spark.createDataFrame([(p,) for p in reversed(paths)], "path string")).orderBy("pos").collect()
    rank = lambda p: 0 if ".app" in p else 1 if p.startswith("/assets/") else 2 if p.startswith("/emojis/") else 8
    assert [(r.pos, r.path, r["rank"], r.depth) for r in rows] == [(n, p, rank(p), p.count("/")) for n, p in enumerate(sorted(paths, key=lambda p: (rank(p), p.count("/"), p)), 1)]


def test_documents_without_lang_or_source_are_files_of_their_own(spark, tmp_path):
    rows = [(1, "a\nb", None, "s"), (2, "c\nd", "en", None), (3, "e", None, None), (4, "f", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.path: (r.content_sha1, r.missing) for r in storage.reassemble_file(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {"//s/1.txt": (sha("a\nb"), 0), "/en//2.txt": (sha("c\nd"), 0), "///3.txt": (sha("e"), 0), "/en/s/4.txt": (sha("f"), 0)}


def test_look_ups_of_all_named_ids(spark):
    named = {r.id for r in fixtures.snapshot_files(spark, SF).where("snap = 30").collect()}
    assert {r.id for r in registry.QUERIES["files_by_ids"](spark, SF).collect()} == named
    assert any(not i.startswith("00") for i in named)
    firsts = {r.c for r in fixtures.document_files(spark, SF).select(F.element_at("chunks", 1).alias("c")).collect()}
    assert {r.chunk_id for r in registry.QUERIES["chunks_by_ids"](spark, SF).collect()} == firsts


def test_the_clouds_ignore_file_counts_where_it_differs(spark):
    d = merge.decided(merging._truth(spark)).withColumn("counts", merge.ignore_counts())
    version = lambda v: v and (v["updated"] // 1000, v["size"], v["chunks"])
    rows = d.collect()
    assert all(r.counts == (r.cloud is not None and version(r.local) != version(r.cloud)) for r in rows)
    one, none = next(r for r in rows if r.counts), next(r for r in rows if not r.counts)
    assert [x.v["id"] for x in merge.cloud_ignore(d, one.path).collect()] == [one.cloud["id"]]
    assert merge.cloud_ignore(d, none.path).isEmpty() and merge.cloud_ignore(d, "/elsewhere").isEmpty()


def test_kept_intervals_against_rows(spark):
    """Versions that kept snapshots hold, and counts a snapshot, by intervals and by a row for each snapshot."""
    from palimpsest.operators import reach, search

    intervals, rows, names = fixtures.version_intervals(spark, SF), fixtures.snapshot_files(spark, SF), fixtures.snapshots(spark)
    for some in ((10, 20, 30), (1,), (), tuple(range(1, 31))):
        kept = names.where(F.col("snap").isin(list(some)) if some else F.lit(False)).select("snapshot_id")
        one = reach.objects_of(reach.in_kept(intervals, names, kept.unionByName(kept)))
        two = reach.reachable(rows, kept)
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    one, two = (x.select("snapshot_id", "count", "size") for x in (search.interval_stats(intervals, names), search.stats(rows)))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    one, two = search.newest_holder_of(intervals, names), search.newest_holder(rows, names)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_titles_are_unescaped_before_they_are_searched(spark):
    from palimpsest.operators import search

    rows = [("/a/20200101000000-abcdefg.sy", "Q&amp;A &lt;new&gt; &quot;x&quot;"), ("/b.sy", "&amp;lt;"), ("/q&a.txt", "other"), ("/q&a.sy", ""), ("/q&a2.sy", None)]
    df = spark.createDataFrame(rows, "path string, title string")
    found = lambda k: {r.path for r in df.where(search.keyword_match(k)).collect()}
    assert found("q&A") == {rows[0][0], "/q&a.txt", "/q&a.sy", "/q&a2.sy"}
    assert found('<NEW> "X"') == {rows[0][0]} and found("&lt;") == {"/b.sy"} and found("amp;") == set()
    assert found("20200101000000-abcdefg") == {rows[0][0]} and len(found("")) == 5
