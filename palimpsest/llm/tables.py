"""Tables in the shared folder that cut lineage, and when they go."""

from __future__ import annotations

import gc
import uuid

from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the folder of setCheckpointDir. Only on a local master, where all is one machine,
    may both be unset: then /tmp/checkpoints. On a cluster that raises, as executors would write where nobody else reads."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        option = context._jsc.sc().getCheckpointDir()
        named = option.get() if option.isDefined() else None
    if not named:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "/tmp/checkpoints"
    return named.rstrip("/")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def saved(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: lineage ends there and survives lost executors.

    With `narrow`, rows are few bytes each and are brought together first, so that not every task of a wide scan leaves a
    small file. The table goes when the session ends, or by `dropped` when nothing reads it any more.
    """
    df = df.hint("rebalance") if narrow else df
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path, store = _path(spark, folder)
    store.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def dropped(*tables: DataFrame) -> None:
    """Delete what `saved` wrote, when nothing reads it any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path, store = _path(df.sparkSession, folder)
            store.delete(path, True)


def released(*broadcasts: Broadcast) -> None:
    """Free the executors' copies of what saved tables no longer need. The driver keeps its own, so a late task still finds it."""
    for b in broadcasts:
        b.unpersist()


def swept(spark: SparkSession) -> None:
    """Shuffle files of plans that are done go now; Spark's cleaner waits until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
