"""Saved tables, their folder, and the filter of ids."""

import os
from types import SimpleNamespace

import numpy as np
import pytest

from palimpsest.llm import sketch, tables


def session(master, conf=None, runtime=None, checkpoint=None):
    option = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    scala = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option))
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: conf), _jsc=scala, master=master)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: runtime))


def test_the_shared_folder_is_the_clusters():
    for master in ("local[4]", "spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        assert tables.shared_folder(session(master, conf="hdfs://x/cp/")) == "hdfs://x/cp"
        assert tables.shared_folder(session(master, runtime="hdfs://y/cp")) == "hdfs://y/cp"
        assert tables.shared_folder(session(master, checkpoint="hdfs://z/cp")) == "hdfs://z/cp"


def test_only_a_local_master_may_name_no_folder():
    assert tables.shared_folder(session("local[8]")) == tables.shared_folder(session("local")) == "/tmp/checkpoints"
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_folder(session(master))


def test_tables_are_written_read_and_dropped(spark):
    for narrow in (False, True):
        t = tables.saved(spark.range(100).repartition(7), "numbers", narrow)
        assert t.count() == 100
        folder = t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(folder)
        tables.dropped(t)
        assert not os.path.exists(folder)


def test_the_filter_misses_no_id_and_passes_few_others(spark):
    ids = spark.range(-5000, 5000).selectExpr("id * 7919 AS id").repartition(3)
    f = sketch.IdFilter(ids, 10_000, 32 << 20)
    assert f.passes(np.arange(-5000, 5000) * 7919).all()
    assert f.passes(np.arange(10**9, 10**9 + 20_000)).mean() < 0.02
    assert len(f.bits) <= 32 << 20
    none = sketch.IdFilter(ids.where("false"), 0, 1 << 20)
    assert not none.passes(np.arange(1000)).any()


def test_rows_are_split_by_the_filter_or_not_at_all(spark):
    df = spark.sql("SELECT IF(id % 10 = 0, NULL, id) AS id, cast(id AS string) AS text FROM range(2000)")
    ids = spark.range(100, 200).select("id")
    part, rest = sketch.rows_of(df, "id", ids, 100)
    some, others = part.collect(), rest.collect()
    assert len(some) + len(others) == 2000 and {r.id for r in some} >= {k for k in range(100, 200) if k % 10}
    assert all(r.id is None or not 100 <= r.id < 200 for r in others) and len(some) < 200
    whole, none = sketch.rows_of(df, "id", ids, 100, max_bytes=8)
    assert none is None and whole.count() == 2000
