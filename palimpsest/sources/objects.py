"""Objects of a store that a Hadoop filesystem reaches (file, hdfs, s3a, webhdfs and others), as rows.

The listing reads no content: of the binary file source only the columns asked for are read. Credentials and endpoints are
those of the session. Writing single objects and signing requests are left to the store's own tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_SUFFIX = ".tmp"


def _rows(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    spark._jvm.org.apache.hadoop.fs.Path(root)  # a malformed root fails here
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base + prefix.rpartition("/")[0])
    # Paths come with a scheme, and with as many slashes after it as the filesystem likes.
    tail = base.split(":", 1)[-1].lstrip("/")
    name = F.substring_index(F.concat(F.lit("/"), F.col("path")), f"/{tail}", -1)
    return rows.withColumn("path", name).where(F.startswith("path", F.lit(prefix)) & ~F.endswith("path", F.lit(SCRATCH_SUFFIX)))


def listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """path below `root`, size, updated (ms) of the objects whose path begins with `prefix`. Unfinished files are no objects;
    names that begin with _ or . are hidden from Spark. A folder that is not there is an error, an empty one has no rows."""
    return _rows(spark, root, prefix).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("updated"))


def contents(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """path and data of the same objects."""
    return _rows(spark, root, prefix).select("path", F.col("content").alias("data"))
