"""Benchmark decontamination: hash set of benchmark n-grams, broadcast block by block, scanned over document windows.

Words are runs of ASCII letters (folded to lower case), digits and any character outside ASCII. An item's windows are
its 13 consecutive words, or the whole item when it is shorter. Each document block is hashed with numpy; runs of words
that all occur in the benchmark are looked up by window hash, and every hit is verified on the words themselves. Windows of
items that agree in two 64-bit hashes are one.

Scale: documents are scanned where they lie, without a shuffle. The benchmark is read once, in blocks of `max_block_bytes` of
text; a block's arrays (hashes, places, items, and the folded text to verify against) take about six bytes a byte. A pass
over the documents looks each block of texts, hashed once, up in `blocks_a_pass` blocks; only a benchmark beyond
their product, 32 MiB, costs another pass, which reads what the one before has saved.

Defined results: a null or empty text has no words and no hits; a null item text has no windows; a null item id is the
item "null"; repeated item ids count once; repeated document rows are judged row by row; an empty benchmark hits nothing; an
input column with the name of a result column gives way to the result, and no other name matters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import ALNUM_FOLDED, U, Words, mix, text_bytes, windows, with_columns
from .tables import released, saved

WINDOW = 13
_ROLL, _CHECK = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(SPAN)), T.StructField("item_ids", T.ArrayType(T.StringType()))]


class Grams:
    """The windows of some items in arrays: by length, the hash pairs that occur, in order, a place of each, and its items."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        data, offsets = text_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
        words = Words(data, offsets, ALNUM_FOLDED)
        h = words.hashes()
        self.folded, self.starts, self.ends = words.folded, words.starts.astype(np.int32), words.ends.astype(np.int32)
        self.names = ["null" if i is None else str(i) for i, _ in items]
        self.vocabulary = np.unique(h)
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.vocabulary >> U(48)).astype(np.int64)] = True
        length = np.minimum(words.counts, size)
        self.by_length = {}
        for n in np.unique(length[length > 0]).tolist():
            place = np.flatnonzero((length[words.rows[: len(h) - n + 1]] == n) & (words.rows[n - 1 :] == words.rows[: len(h) - n + 1]))
            first, second, item = windows(h, n, _ROLL)[place], windows(h, n, _CHECK)[place], words.rows[place]
            order = np.lexsort((item, second, first))
            first, second, item, place = first[order], second[order], item[order], place[order]
            new = np.ones(len(order), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            own = new.copy()
            own[1:] |= item[1:] != item[:-1]
            at = np.flatnonzero(new)
            self.by_length[n] = (first[at], place[at].astype(np.int32), item[own].astype(np.int32), np.append(np.cumsum(own)[at] - 1, own.sum()))

    def known(self, h: np.ndarray) -> np.ndarray:
        out = self.flags[(h >> U(48)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        out[maybe] = self.vocabulary[at] == h[maybe]
        return out

    def same(self, words: Words, a: int, b: int, n: int) -> bool:
        """Whether n words from a on are the same as the items' from b on."""
        if not np.array_equal(words.ends[a : a + n] - words.starts[a : a + n], self.ends[b : b + n] - self.starts[b : b + n]):
            return False
        x, y = words.folded[words.starts[a] : words.ends[a + n - 1]], self.folded[self.starts[b] : self.ends[b + n - 1]]
        return np.array_equal(x[x != 0], y[y != 0])

    def hits(self, words: Words, h: np.ndarray):
        """(first word, length, items) of each verified window, by position within the block."""
        if not self.by_length or not len(h):
            return
        total = np.concatenate([[0], np.cumsum(self.known(h), dtype=np.int32)])
        for n, (hashes, place, item, cut) in self.by_length.items():
            last = len(h) - n + 1
            if last <= 0:
                continue
            starts = np.flatnonzero((total[n:] - total[:-n] == n) & (words.rows[n - 1 :] == words.rows[:last]))
            if not len(starts):
                continue
            value = h[starts].copy()
            for j in range(1, n):
                value *= U(_ROLL)
                value += h[starts + j]
            value = mix(value)
            lo, hi = np.searchsorted(hashes, value), np.searchsorted(hashes, value, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                for at in range(lo[i], hi[i]):
                    if self.same(words, int(starts[i]), int(place[at]), n):
                        yield int(starts[i]), n, item[cut[at] : cut[at + 1]]
                        break


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(df: DataFrame, text: str, shared: list) -> DataFrame:
    """`df`, all of whose columns have names of their own, with FIELDS; earlier findings are in before_spans and before_items."""
    first = "before_spans" not in df.columns

    def make():
        every = [g.value for g in shared]

        def block(batch, data, offsets):
            words = Words(data, offsets, ALNUM_FOLDED)
            h = words.hashes()
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for g in every:
                found: dict[int, list] = {}
                for start, length, numbers in g.hits(words, h):
                    row = int(words.rows[start])
                    a = start - int(words.firsts[row])
                    spans[row].append((a, a + length))
                    found.setdefault(row, []).append(numbers)
                for row, numbers in found.items():
                    items[row].update(g.names[k] for k in np.unique(np.concatenate(numbers)).tolist())
            if not first:
                for row, (s, i) in enumerate(zip(batch.column("before_spans").to_pylist(), batch.column("before_items").to_pylist(), strict=True)):
                    spans[row] += [(x["start"], x["end"]) for x in s]
                    items[row].update(i)
            return words.counts, [[{"start": a, "end": b} for a, b in merged(s)] for s in spans], [sorted(i) for i in items]

        return block

    return with_columns(df, text, FIELDS, make).drop("before_spans", "before_items")


def _blocks_of(items: DataFrame, size: int, max_block_bytes: int):
    """Grams of the items, read once, in blocks of about `max_block_bytes` of text or one longer item."""
    held, n = [], 0
    for r in items.toLocalIterator():
        held.append((r.id, r.t))
        n += len((r.t or "").encode())
        if n >= max_block_bytes:
            yield Grams(held, size)
            held, n = [], 0
    yield Grams(held, size)


def _marked(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, max_block_bytes: int = 8 << 20, blocks_a_pass: int = 4) -> DataFrame:
    """`docs` with its columns numbered (c0 and so on), and FIELDS. The driver builds one block of the benchmark at a time and
    holds those of one pass."""
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t"))
    names = docs.columns
    out, column = docs.toDF(*(f"c{k}" for k in range(len(names)))), f"c{names.index(text)}"
    shared = []
    for grams in _blocks_of(items, size, max_block_bytes):
        if len(shared) == blocks_a_pass:
            out = saved(_scan(out, column, shared), "scanned").withColumnsRenamed({"hit_spans": "before_spans", "item_ids": "before_items"}).drop("n_words")
            released(*shared)
            shared = []
        shared.append(context.broadcast(grams))
    return _scan(out, column, shared)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with n_words, hit_spans (merged word intervals that windows cover) and item_ids (strings, sorted)."""
    new = [f.name for f in FIELDS]
    marked = _marked(docs, benchmark, text, **options)
    return marked.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in new), *new)


def n_hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def contaminated() -> F.Column:
    """At least a twentieth of the words, and one at least, lie in benchmark windows."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The clean rows of `docs`, with its columns in its order."""
    clean = _marked(docs, benchmark, text, **options).where(~contaminated())
    return clean.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with the hit words cut out of the text, each cut leaving one space; other bytes stay as they are."""
    place = docs.columns.index(text)
    marked = _marked(docs, benchmark, text, **options)

    def make():
        def block(batch, data, offsets):
            words, out = Words(data, offsets, ALNUM_FOLDED), []
            for row, (value, spans) in enumerate(zip(batch.column(f"c{place}").to_pylist(), batch.column("hit_spans").to_pylist(), strict=True)):
                if spans:
                    raw, base, first = value.encode(), int(offsets[row]), int(words.firsts[row])
                    for s in reversed(spans):
                        raw = raw[: int(words.starts[first + s["start"]]) - base] + b" " + raw[int(words.ends[first + s["end"] - 1]) - base :]
                    value = raw.decode()
                out.append(value)
            return (pa.array(out, pa.string()),)

        return block

    cut = with_columns(marked, f"c{place}", [T.StructField("cut", T.StringType())], make)
    return cut.select(*(F.col("cut" if c == text else f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def op1_decontaminate(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = scan(docs.select("doc_id", "text"), items)
    return marked.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM (SELECT *, least(13, len(w)) AS k FROM i WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lengths WHERE len(w) >= k)),
h AS (SELECT doc_id, s, p.k, item_id FROM p JOIN g ON p.g = g.g AND p.k = g.k),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS t FROM h) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
