"""Site-relative line dedup: a line that many of a host's pages carry is boilerplate there. DataFrame functions only.

A host's pages that contain a line (each page counts once) are divided by the host's page total; lines above `percent`,
on `min_pages` pages at least, are dropped from that host's pages. Lines end at newline; blank lines are neither counted
nor dropped.

Scale: pages are reduced to line digests before the shuffle, which is keyed by (host, digest) and pre-aggregated. A host
has at most 100 / percent times its lines a page as boilerplate, so the table of lines to drop is small beside the pages;
it is saved first, so that Catalyst broadcasts it if its measured size allows and otherwise joins by host, where the
adaptive skew split cuts a hot host's pages.

Defined results: a null host is a host of its own; a null text has no lines and stays null; a page whose lines all go has
an empty text; repeated rows each count as a page. With `copies_once`, pages of a host that have the same set of lines count
as one page, both for their lines and in the total, so that a group of copies does not make its own lines boilerplate (all
pages without lines, null ones as well, are then up to two pages). Near copies still count each; with `most_lost` below 100, a
page that would lose more than that percent of its lines stays whole: it is a copy of other pages rather than a page with
boilerplate on it, and for the removal of near copies to judge. Ties at `percent` stay. An empty table gives an empty one; columns
of any name are carried in one struct, so none clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved

PERCENT, MIN_PAGES = 8, 5


def _digest(line):
    return F.unhex(F.md5(line.cast("binary")))


def _blank(line):
    return F.trim(F.translate(line, "\t\r\u000b\u000c", "    ")) == ""


def host_of(url):
    """The host of a URL in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def boilerplate(pages: DataFrame, percent: int = PERCENT, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """__host and __drop, the digests of its boilerplate lines, of `pages` (__host, text)."""
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: ~_blank(x)), _digest))
    pages = pages.select("__host", lines.alias("lines"))
    if copies_once:
        # One row a task and copy group is shuffled. The lines follow as digests; saved, as both counts read them.
        page = F.md5(F.array_join(F.transform(F.sort_array("lines"), F.hex), "").cast("binary"))
        pages = saved(pages.withColumn("page", F.unhex(page)).dropDuplicates(["__host", "page"]).drop("page"), "pages")
    counts = pages.select("__host", F.explode("lines").alias("line")).groupBy("__host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("__host").agg(F.count("*").alias("pages"))
    above = counts.join(totals, "__host").where(100 * F.col("n") > percent * F.col("pages"))
    return above.groupBy("__host").agg(F.collect_list("line").alias("__drop"))


def dedup(pages: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES, copies_once: bool = False, most_lost: int = 100) -> DataFrame:
    """__row (a struct of `pages`' columns), kept_text, n_lines and n_dropped."""
    key = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("-"))
    keyed = pages.select(F.struct("*").alias("__row"), key.alias("__host"), F.col(text).alias("text"))
    drop = saved(boilerplate(keyed.select("__host", "text"), percent, min_pages, copies_once), "lines")
    joined = keyed.join(drop, "__host", "left").withColumn("__lines", F.split("text", "\n", -1))
    kept = F.filter("__lines", lambda x: _blank(x) | ~F.array_contains("__drop", _digest(x)))
    joined = joined.withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(kept))
    if most_lost < 100:
        own = F.size(F.filter("__lines", lambda x: ~_blank(x)))
        lost = F.size("__lines") - F.size("__kept")
        joined = joined.withColumn("__kept", F.when(100 * lost > most_lost * own, F.col("__lines")).otherwise(F.col("__kept")))
    some, none = F.col("text").isNotNull(), F.lit(0).cast("long")
    n, left = F.size("__lines").cast("long"), F.size("__kept").cast("long")
    return joined.select(
        "__row",
        F.when(some, F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "__kept"))).alias("kept_text"),
        F.when(some, n).otherwise(none).alias("n_lines"),
        F.when(some, n - left).otherwise(none).alias("n_dropped"),
    )


def remove_lines(pages: DataFrame, host: str = "source", text: str = "text", **options) -> DataFrame:
    """`pages` with the boilerplate lines gone from `text`."""
    return dedup(pages, host, text, **options).select(*(F.col("kept_text").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in pages.columns))


def op5_line_dedup(spark, sf_dir):
    done = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return done.select("__row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, text, coalesce('=' || source, '-') AS host FROM documents),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d WHERE text IS NOT NULL),
f AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY 1, 2),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY 1),
b AS (SELECT host, line FROM f JOIN t USING (host) WHERE n >= 5 AND 100 * n > 8 * pages),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n_kept FROM l ANTI JOIN b USING (host, line) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines, 0) - coalesce(n_kept, 0) AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
