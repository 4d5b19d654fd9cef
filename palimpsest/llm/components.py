"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, saved


def _least(edges: DataFrame) -> DataFrame:
    """Per node u the least of itself and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each component, for every node that `edges` (u, v) names.

    A round moves every edge towards the least node seen around it; the number of rounds grows with the logarithm of
    the longest chain. Hubs are safe: the minimum is aggregated before the shuffle and the join can split a hub's rows.
    """
    # Rows are two longs: an eighth of the shuffle's partitions, and so of the files, is plenty for a table a round.
    files = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    kept = lambda df: saved(df.distinct().coalesce(files), "edges")
    now = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        then = kept(small.unionByName(least.select("u", F.col("m").alias("v"))))
        before, now = now, then
        dropped(before)
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if told == state:
            break
        state = told
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
