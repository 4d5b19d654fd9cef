"""Exact removal of repeated word windows, behind a count-min prefilter.

Words are runs of anything but ASCII white space, unchanged. A window is 20 consecutive words of one document; a word is
removed when a window that covers it starts earlier as well (smaller doc_id, or same document and earlier start).

1. Sketch. Each task hashes its windows into two rows of counters that saturate at two, in chunks, and emits the counters
   it touched as byte-coded gaps, cut into slices. Slices are merged by addition; what is kept is one bit a counter:
   two or more. A window whose bits are both set is estimated repeated; estimates are never too low. Tasks of the second pass
   drop all other windows block by block, before anything is gathered.
2. Exact pass. Only windows estimated repeated go on. Within a chunk all but the earliest occurrence are marked at once,
   so a window contributes one row a chunk to the shuffle however often it occurs. Those rows are ranked by 95-bit window hash;
   all but the first are marked. Nothing is lost to the sketch: it only spares windows that occur once.
3. Marks are gathered by document, saved, and applied to its words; documents without marks stay where they lie.

The sketch has `counters_per_byte` counters a row and byte of text, `max_sketch_bytes` of bits at most: that bounds the
broadcast. Beyond it the prefilter spares fewer windows and the results stay the same.

Defined results: null or empty text has no words. Texts of fewer than 20 words stay whole. A null doc_id counts as the
smallest. Rows that share a doc_id count as one document: equal starts are the same occurrence, and a mark holds for all
of them; each row gives a result row. Of equal windows the one with the least (doc_id, start) stays, so there are no ties. Texts of any
length are read whole, at some fifty bytes a word. An empty table gives an empty one. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import SPACED, U, Words, mix, row_blocks, trim, windows, with_columns
from .sketch import COUNTERS_PER_BYTE, MAX_BYTES, counter_bits, passing, sieve_of, size_for
from .tables import released, saved

WINDOW = 20
CHUNK = 1 << 19
_ROLL, _CHECK = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
KEY = -(1 << 63)
#: A row of the exact pass, packed: the last bit of h is 0 for an occurrence (high half of `at`: 32 more hash bits) and 1
#: for a run of known later starts (high half: its length). The low half of `at` is the start.
ROW = T.StructType([T.StructField(n, T.LongType()) for n in ("h", "at", "doc")])


def window_blocks(batches, size: int):
    """Per block: hashes of the windows of its texts, the numbers of their first words, the words, their hashes, and the block."""
    for block, data, offsets in row_blocks(batches, "text"):
        words = Words(data, offsets, SPACED)
        h = words.hashes()
        whole = windows(h, size, _ROLL)
        if len(whole):
            inside = np.flatnonzero(words.rows[size - 1 :] == words.rows[: len(whole)])
            yield whole[inside], inside, words, h, block


def sketch(docs: DataFrame, size: int, width: int, spread: int = 1) -> bytes:
    """The bits of counters that are two or more, over all windows of `docs` (doc, text)."""
    return counter_bits(docs, lambda batches: (x[0] for x in window_blocks(batches, size)), width, spread=spread)


def suspects(batches, size: int, width: int, bits: bytes, chunk: int):
    """(h, 32 more bits, doc, start) of the windows estimated repeated, in chunks of about `chunk`; others are never held."""
    held, n = [], 0
    for whole, inside, words, h, block in window_blocks(batches, size):
        keep = np.flatnonzero(passing(bits, whole, width))
        if not len(keep):
            continue
        inside = inside[keep]
        rows = words.rows[inside]
        other = (windows(h, size, _CHECK)[inside] >> U(32)).astype(np.uint32).view(np.int32)
        docs = block.column("doc").to_numpy(zero_copy_only=False)[rows]
        held.append((whole[keep] & ~U(1), other, docs, (inside - words.firsts[rows]).astype(np.int32)))
        n += len(keep)
        if n >= chunk:
            yield _joined(held)
            n = 0
    if n:
        yield _joined(held)


def _joined(held: list) -> list[np.ndarray]:
    """The parts of each column as one array, a column at a time; `held` is empty afterwards."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    for k, parts in enumerate(columns):
        columns[k] = np.concatenate(parts)
        parts.clear()
    return columns


def firsts(chunk: list[np.ndarray]) -> pa.RecordBatch:
    """ROWs of a chunk of suspects: the earliest occurrence of each window, and runs of the starts of others. `chunk` is used up."""
    order = np.lexsort(chunk[::-1])
    for k in range(4):
        chunk[k] = chunk[k][order]
    del order
    h, h2, doc, start = chunk
    chunk.clear()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    # Equal starts of equal doc_ids are one occurrence.
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(first, append=len(h)))
    later = (doc != doc[group]) | (start != start[group])
    del first, group
    d, s = doc[later], start[later]
    h, h2, doc, start = h[new], h2[new], doc[new], start[new]
    del new, later
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    del order
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    runs = np.flatnonzero(fresh)
    ends = np.append(runs[1:], len(d)) - 1
    length = (s[ends] - s[runs] + 1).astype(np.int32) if len(d) else np.zeros(0, np.int32)
    d, s = d[runs], s[runs]
    del fresh, runs, ends
    spread = mix(d.astype(np.int64).view(U) ^ (s.astype(U) << U(40))) | U(1)
    at = np.concatenate([h2, length]).astype(np.int64)
    at <<= 32
    at |= np.concatenate([start, s])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, spread]).view(np.int64)), pa.array(at), pa.array(np.concatenate([doc, d]))], ROW.names)


def occurrences(docs: DataFrame, size: int, width: int, bits) -> DataFrame:
    """ROWs: the earliest occurrence in its chunk of each window estimated repeated, and runs of starts already known to be
    later ones."""

    def find(batches):
        yield from map(firsts, suspects(batches, size, width, bits.value, CHUNK))
        trim()

    return docs.mapInArrow(find, ROW)


def marks(docs: DataFrame, size: int = WINDOW, counters_per_byte: float = COUNTERS_PER_BYTE, max_sketch_bytes: int = MAX_BYTES) -> DataFrame:
    """doc and runs (start << 32 | number of starts) of the windows of `docs` (doc, text) that also start earlier; saved."""
    width, spread = size_for(docs, counters_per_byte, max_sketch_bytes)
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, width, spread))
    rows = occurrences(docs, size, width, bits)
    high, start = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    known = F.col("h").bitwiseAND(F.lit(1).cast("long")) == 1
    # One exchange by h serves the window by (h, high).
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = rows.repartition(parts, "h").withColumn("high", high).withColumn("rank", F.rank().over(Window.partitionBy("h", "high").orderBy("doc", "at")))
    later = ranked.where(known | (F.col("rank") > 1))
    out = saved(later.groupBy("doc").agg(F.collect_list(F.shiftleft(start, 32) + F.when(known, F.col("high")).otherwise(1)).alias("runs")), "marks")
    released(bits)
    return out


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WINDOW, with_text: bool = True, **options) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and, on request, kept_text: the kept words joined by one space."""
    docs = docs.select(F.col(id).alias("id"), F.coalesce(F.col(id), F.lit(KEY)).cast("long").alias("doc"), F.col(text).alias("text"))
    marked = marks(docs.select("doc", "text"), size, **options)
    docs = docs.withColumn("runs", F.lit(None).cast("array<bigint>"))
    # Only texts that marks may touch are shuffled; a bounded filter of their ids tells.
    part = sieve_of(docs.sparkSession, marked.select("doc"), marked.count())
    touched = docs.drop("runs")
    if part is not None:
        touched = touched.mapInArrow(part("doc", True), touched.schema)

    def make():
        def block(batch, data, offsets):
            n, removed, digests, texts = [], [], [], []
            for row, runs in enumerate(batch.column("runs").to_pylist()):
                words = data[offsets[row] : offsets[row + 1]].tobytes().split()
                n.append(len(words))
                if runs:
                    at = np.array(runs, np.int64)
                    change = np.zeros(len(words) + 1, np.int64)
                    start = at >> 32
                    np.add.at(change, np.minimum(start, len(words)), 1)
                    np.add.at(change, np.minimum(start + (at & 0xFFFFFFFF) + size - 1, len(words)), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                kept = b" ".join(words)
                removed.append(n[-1] - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            return (n, removed, digests, texts)[: 3 + with_text]

        return block

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
    def made(rows, only=None):
        return with_columns(rows, "text", fields[: 3 + with_text], make, needed=["id", "doc", "runs"], only=only).drop("doc", "runs").withColumnRenamed("id", id)

    # By a shuffle even if there are few marks: over a broadcast, the filter and the digests would be two maps of one stage.
    out = made(touched.join(marked.hint("merge"), "doc", "left"))
    return out if part is None else out.unionByName(made(docs, part("doc", False)))


def op2_substring_dedup(spark, sf_dir):
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS x FROM r WHERE k > 1),
m AS (SELECT doc_id, list(x) AS gone FROM c GROUP BY 1),
k AS (SELECT doc_id, len(w) AS n, w, coalesce(gone, []) AS gone FROM d LEFT JOIN m USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM k),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS kept FROM u ANTI JOIN c USING (doc_id, x) GROUP BY 1)
SELECT k.doc_id, cast(n AS bigint) AS n_words, cast(len(gone) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN t USING (doc_id)
"""
