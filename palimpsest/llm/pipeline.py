"""A training corpus from `documents`: quality, boilerplate lines, near duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows to the shared checkpoint
folder, reads them again for the next one and then deletes the table before. All stages but the last return the columns of
`documents`, with n_chars as the text is then.

Defined results, for every stage: an empty table gives an empty one; extra columns stay, whatever their names (packing has
its own columns only); repeated rows are judged row by row and stay, but for near duplicates, which keeps one of them.
What each stage makes of null and empty texts, null ids and ties is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, line_dedup, packing, quality
from .sketch import rows_of
from .tables import dropped, saved


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling takes; those it rejects go.

    Null and empty texts have no features and are judged by the odds of none; rows of one id and equal texts share their
    draw; ties at the cut all stay; without labels of either kind everything stays.
    """
    return quality.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many documents of their source carry. Copies count once there, and a document
    that would lose more than half of its lines stays whole: copies and near copies are left to the removal of near
    duplicates, which keeps one.

    A null text stays null, an empty one empty; a null source is a source of its own; null ids don't matter.
    """
    cut = line_dedup.remove_lines(docs, host="source", copies_once=True, most_lost=50)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Rows, not ids, are linked and go, so ids may repeat or be null: a null doc_id comes last, and between rows of one doc_id
    the row's hash decides. Rows equal in all columns are one row. Other rows without words, null and empty texts, stay.
    """
    names = docs.columns
    text, doc_id = (F.col(f"c{names.index(c)}") for c in ("text", "doc_id"))
    flat = docs.toDF(*(f"c{k}" for k in range(len(names))))
    keyed = flat.withColumn("key", F.xxhash64(*(x for c in flat.columns for x in (F.col(c), F.col(c).isNull()))))
    member = jaccard_join.join(keyed.select("key", text.alias("text")), id="key", percent=80, size=5).select("key", "component_id")
    # Equal rows are counted, and groups found by what their other members name: no join brings a whole group together.
    rows = saved(member.groupBy("key", "component_id").agg(F.count("*").alias("n")), "rows")
    first = rows.where("key <> component_id").select(F.col("component_id").alias("key"), "component_id").distinct()
    grouped = saved(rows.where("key <> component_id OR n > 1").select("key", "component_id").unionByName(first).distinct(), "grouped")
    # Only rows of groups are shuffled; a bounded filter of row hashes tells.
    doubtful, rest = rows_of(keyed, "key", grouped.select("key"), grouped.count())
    ids = doubtful.select("key", doc_id.alias("id")).join(grouped, "key")
    least = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least"))
    gone = saved(grouped.select("key").join(least.select("least.key"), "key", "left_anti"), "gone")
    dropped(rows, grouped)
    kept = doubtful.join(gone, "key", "left_anti").dropDuplicates(["key"])
    every = kept if rest is None else kept.unionByName(rest)
    return every.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words lies in benchmark windows.

    Null and empty texts have no words and stay, as everything does where the benchmark is empty; exactly a twentieth goes.
    """
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences of at most 4096 tokens.

    A null or empty text is its end token; null ids stay null; rows of one id are packed each by itself.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can express neither the tokenizer nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
