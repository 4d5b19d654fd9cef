"""Similarity join of word-shingle sets by PartEnum signatures, and its connected components.

A document's set is its distinct 3-word shingles (lower-cased ASCII, words split at ASCII white space). Sets with
100 * |a and b| >= 90 * |a or b| link; documents with equal sets are one class, represented by its least doc_id.

Signatures. Set sizes fall into bands such that linked sets are in the same or neighbouring bands; an instance serves two
neighbouring bands, and its equal-size-band sets differ in at most k elements if linked. An instance divides the shingle
domain by hash into n1 parts, and each part into 4 again. Every pair of a part's 4 is enumerated, and a signature is a hash of
the elements in a pair. j differing elements in a part leave 3 - j of its 6 pairs untouched at least, so linked sets agree on
3 n1 - k pairs at least. The same number less one are left out, the last in an order that content alone decides (fullest
first): the first pair that both agree on is not among the last ones of either set. n1 is (k + 1) / 2.5, rounded up, so about
a twelfth of the pairs is left out, those with few or no elements, which many sets would share.

A signature covers 10 or more shingles of a long set at 90 %, and 5 at 80 %. No scheme that misses nothing can have many more:
differences may lie anywhere, and the number of signatures grows exponentially with what each covers.

A count-min sketch of all shingles tells which may be repeated (never too few); beyond what `max_sketch_bytes` can count,
shingles are counted in a shuffle and the sketch holds the repeated ones alone. An element that no other set has is a
difference to each of them, so a set with more than k such elements, a part with more than 2 and a pair with any emit
nothing: a set that shares less than about the linking part of its shingles with the rest of the corpus has no signatures.

Candidates. Sets that share a signature are joined to one of them, not paired: each task keeps one row a signature, the
shuffle brings together at most one row a task, and each gets an edge to the first. Components of these edges hold all
possible links. They are verified exactly, with sets compared within blocks of about `block` members and at most
`block_shingles` shingles (or one longer set) by matrix product. Only a spanning forest of the links of a pair of blocks leaves
the task, so neither candidates nor links are ever written out as pairs. A component of up to `few` blocks is dealt as all pairs
of its blocks. In a larger one all blocks are first compared with one of them and each within itself, two rows a member; members
that this connects need not be compared again. Families so found get blocks of their own, and only pairs of blocks that are not
of one family follow. So a large group of near copies costs rows in proportion to its size, times the blocks of members that it
does not connect; equal sets count once.

Defined results: null, empty or blank text has an empty set, size 0, and is its own component. Fewer than 3 words are one
shingle. A null doc_id stays null and its document links with nothing. Repeated doc_ids link like their texts and share
the id. A similarity of exactly `percent` links. Texts of any length are read whole; a long one is a block of its own. An empty
table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .kernel import SPACED_FOLDED, U, Words, mix, row_blocks, with_columns
from .sketch import Repeats, rows_of
from .tables import dropped, released, saved, swept

SHINGLE, CELLS = 3, 4
CHUNK = 1 << 20
_ROLL = U(0xFF51AFD7ED558CCD)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted."""
    words = Words(data, offsets, SPACED_FOLDED)
    h = words.hashes()
    n = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    rows = np.repeat(np.arange(len(n)), n)
    at = np.repeat(words.firsts[:-1] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(len(rows))
    last = words.firsts[1:][rows]
    value = np.zeros(len(rows), U)
    for j in range(size):
        inside = at + j < last
        value = value * _ROLL + np.where(inside, h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else U(0), U(1))
    value = mix(value)
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    return rows[new], value[new]


def sums(code: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by code, modulo 2**64."""
    low = np.bincount(code, (value & U(0xFFFFFFFF)).astype(np.float64), n).astype(np.int64).astype(U)
    high = np.bincount(code, (value >> U(32)).astype(np.float64), n).astype(np.int64).astype(U)
    return low + (high << U(32))


def digests(rows: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set."""
    return mix(sums(rows, mix(value ^ U(0x5851F42D4C957F2D)), n)), mix(sums(rows, mix(value ^ U(0x14057B7EF767814F)), n))


def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """The largest set size of each band."""
    ends = [1]
    while ends[-1] < most:
        ends.append((ends[-1] + 1) * 100 // percent)
    return np.array(ends, np.int64)


def signatures(rows: np.ndarray, value: np.ndarray, n: int, percent: int, repeated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of n sets, by PartEnum. `repeated`: which elements other sets may have as well (all, by default)."""
    ends = bands(percent)
    size = np.bincount(rows, minlength=n)
    band = np.searchsorted(ends, size)
    spread, weight = mix(value ^ U(0x2545F4914F6CDD1D)) >> U(32), mix(value ^ U(0x9FB21C651E98DF25))
    single = np.zeros(len(value), bool) if repeated is None else ~repeated
    singles = np.bincount(rows[single], minlength=n)
    out_s, out_r = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for step in (0, 1):
        instance = band + step
        k = 2 * ends[instance] * (100 - percent) // (100 + percent)
        alive = (size > 0) & (k > 0) & (singles <= k)
        n1 = np.where(alive, (2 * (k + 1) + 4) // 5, 0)
        base = np.concatenate([[0], np.cumsum(n1)])
        use = alive[rows]
        r = rows[use]
        cell = base[r] * CELLS + ((spread[use] * (n1[r] * CELLS).astype(U)) >> U(32)).astype(np.int64)
        cells = int(base[-1]) * CELLS
        total, inside, alone = (x.reshape(-1, CELLS) for x in (sums(cell, weight[use], cells), np.bincount(cell, minlength=cells), np.bincount(cell[single[use]], minlength=cells)))
        part = np.flatnonzero(alone.sum(axis=1) <= CELLS - 2)
        row = np.repeat(np.arange(n), n1)[part]
        total, inside, alone = total[part], inside[part], alone[part]
        salt = mix((instance[row].astype(U) << U(40)) ^ ((part - base[row]).astype(U) << U(8)) ^ U(0xA0761D6478BD642F))
        found = []
        for number, (x, y) in enumerate(combinations(range(CELLS), 2)):
            keep = alone[:, x] + alone[:, y] == 0
            found.append((row[keep], inside[keep, x] + inside[keep, y], mix(total[keep, x] + total[keep, y] ^ mix(salt[keep] + U(number)))))
        row, held, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((s, -held, row))
        row, s = row[order], s[order]
        first = np.searchsorted(row, np.arange(n + 1))
        keep = np.arange(len(row)) - first[row] < (np.diff(first) - (3 * n1 - k - 1))[row]
        out_s.append(s[keep])
        out_r.append(row[keep])
    return np.concatenate(out_s), np.concatenate(out_r)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _star(s: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges from each node to the first of its signature; sorted by signature."""
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    centre = node[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(s) else node
    return _distinct(node[~new], centre[~new])


def repeated_shingles(docs: DataFrame, size: int, max_bytes: int | None = None) -> Repeats:
    """Which shingles more than one text may have, over each text's distinct ones."""
    return Repeats(docs.select("text"), lambda batches: (shingles(data, offsets, size)[1] for _, data, offsets in row_blocks(batches, "text")), max_bytes)


def candidate_edges(docs: DataFrame, percent: int, size: int, repeated) -> DataFrame:
    """u, v: digests of sets that may link, as stars. A chunk's own edges pass through the shuffle under a null signature.
    `repeated`: a broadcast of repeated_shingles."""

    def local(batches):
        held, n = [], 0

        def flush():
            s, node = _distinct(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            u, v = _star(s, node)
            s, node = s[first], node[first]
            none = np.arange(len(s) + len(u)) < len(s)
            columns = np.concatenate([s, u]), np.concatenate([node, u]), np.concatenate([np.zeros(len(s), U), v])
            arrays = [pa.array(x.view(np.int64), mask=m) for x, m in zip(columns, (None, None, none), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["s", "u", "v"])

        for block, data, offsets in row_blocks(batches, "text"):
            rows, value = shingles(data, offsets, size)
            first, _ = digests(rows, value, block.num_rows)
            s, row = signatures(rows, value, block.num_rows, percent, repeated.value.passes(value))
            if len(s):
                held.append((s, first[row]))
                n += len(s)
            if n >= CHUNK:
                out = flush()
                held, n = [], 0
                yield out
        if held:
            yield flush()

    def meet(batches):
        last_s, last_u = None, None
        for batch in batches:
            v = batch.column("v")
            own = v.is_valid().to_numpy(zero_copy_only=False)
            s, u = (batch.column(c).to_numpy() for c in ("s", "u"))
            a, b = u[own], v.drop_null().to_numpy()
            s, u = s[~own], u[~own]
            if len(s):
                if last_s is not None:
                    s, u = np.concatenate([last_s, s]), np.concatenate([last_u, u])
                at = np.searchsorted(s, s[-1])  # the centre of the signature that may go on in the next batch
                last_s, last_u = s[-1:], u[at : at + 1]
                x, y = _star(s, u)
                a, b = np.concatenate([a, x]), np.concatenate([b, y])
            if len(a):
                a, b = _distinct(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    rows = docs.select("text").mapInArrow(local, "s long, u long, v long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "s").sortWithinPartitions("s").mapInArrow(meet, "u long, v long").where("u <> v").distinct()


def forest(sets: list[np.ndarray], percent: int, cut: int | None = None, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links among `sets` (hash arrays); with `cut`, only links across that position count."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(m), size)
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    member, column = member[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    common = np.zeros((m, m), np.float32)
    for a in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        x = np.zeros((m, columns), np.float32)
        x[member[lo:hi], column[lo:hi] - a] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    if cut is not None:
        linked[:cut, :cut] = linked[cut:, cut:] = False
    np.fill_diagonal(linked, False)
    out, seen = [], np.zeros(m, bool)
    for root in range(m):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(linked[x] & ~seen):
                seen[y] = True
                out.append((x, int(y)))
                stack.append(int(y))
    return out


def dealt(rows: DataFrame, others) -> DataFrame:
    """`rows` (comp, own, doc, text) once for each pair of their block `own` and one of the array `others`."""
    pairs = rows.select("comp", "doc", "text", "own", F.explode(others).alias("other"))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    return pairs.select("comp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side, "doc", "text")


def numbers(first, end):
    """The integers from `first` to before `end`, as an array."""
    return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))


def verified_edges(members: DataFrame, percent: int, size: int, whole: bool = False) -> DataFrame:
    """u, v of links in each group, of rows (comp, a, b, side, doc, text): those of block a and of block b of a component. With
    `whole`, links within the two blocks count as well."""

    def check(batches):
        group, held, total = None, [], 0

        def flush():
            nonlocal held, total
            docs, sets, cut = [], [], None
            held.sort(key=lambda x: x[0])
            for side, doc, s in held:
                if side == 1 and cut is None:
                    cut = len(docs)
                docs.append(doc)
                sets.append(s)
            within = whole or group[1] == group[2]
            edges = forest(sets, percent, None if within else (len(docs) if cut is None else cut)) if len(docs) > 1 else []
            held, total = [], 0
            if edges:
                return pa.RecordBatch.from_arrays([pa.array([docs[x] for x, _ in edges], pa.int64()), pa.array([docs[y] for _, y in edges], pa.int64())], ["u", "v"])

        for part, data, offsets in row_blocks(batches, "text"):
            rows, value = shingles(data, offsets, size)
            cut = np.searchsorted(rows, np.arange(part.num_rows + 1))
            for i, (comp, a, b, side, doc) in enumerate(zip(*(part.column(c).to_pylist() for c in ("comp", "a", "b", "side", "doc")), strict=True)):
                if (comp, a, b) != group:
                    if held and (out := flush()):
                        yield out
                    group = (comp, a, b)
                held.append((side, doc, value[cut[i] : cut[i + 1]]))
        if held and (out := flush()):
            yield out

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "comp", "a", "b").sortWithinPartitions("comp", "a", "b").mapInArrow(check, "u long, v long").distinct()


def linked(docs: DataFrame, members: DataFrame, percent: int, size: int, block: int, block_shingles: int, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """u, v: links enough to connect what is connected, among `members` (doc, comp, n) of each comp; and the tables it reads."""
    n_blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    within = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    sized = members.join(members.groupBy("comp").agg(n_blocks.alias("blocks")), "comp").withColumn("own", within(F.col("blocks")))
    large = saved(sized.where(F.col("blocks") > few), "large")
    # Most texts are in no component; a bounded filter keeps them out of the shuffle.
    texts = rows_of(docs, "doc", members.select("doc"), members.count())[0].select("doc", "text")
    pairs = dealt(sized.where(F.col("blocks") <= few).join(texts, "doc"), numbers(F.lit(0), F.col("blocks")))
    if large.isEmpty():
        return verified_edges(pairs, percent, size), [large]
    texts = saved(large.select("doc").join(texts, "doc"), "texts")
    others = F.when(F.col("own") == 0, numbers(F.lit(1), F.col("blocks"))).otherwise(F.array(F.lit(0)))
    first = saved(verified_edges(dealt(large.join(texts, "doc"), others), percent, size, whole=True), "links")
    found = components(first).select(F.col("node").alias("doc"), "component")
    labelled = saved(large.drop("own", "blocks").join(found, "doc", "left").withColumn("label", F.coalesce("component", "doc")), "labelled")
    family = labelled.groupBy("comp", "label").agg(F.count("*").alias("m")).select("comp", "label", (F.col("m") >= block).alias("pure"))
    family = family.withColumn("family", F.when(F.col("pure"), F.col("label")).otherwise(0))
    named = labelled.join(family, ["comp", "label"]).select("comp", "doc", "n", "pure", "family")
    key, w = ["comp", "pure", "family"], Window.partitionBy("comp")
    kinds = named.groupBy(*key).agg(n_blocks.alias("blocks"))
    before = F.coalesce(F.sum("blocks").over(w.orderBy("pure", "family").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = kinds.select(*key, "blocks", before.cast("int").alias("first"), F.sum("blocks").over(w).cast("int").alias("total"))
    rows = named.join(kinds, key).join(texts, "doc").withColumn("own", F.col("first") + within(F.col("blocks")))
    others = F.concat(numbers(F.lit(0), F.col("first")), numbers(F.col("first") + F.col("blocks"), F.col("total")))
    others = F.when(F.col("pure"), others).otherwise(numbers(F.lit(0), F.col("total")))
    edges = verified_edges(pairs.unionByName(dealt(rows, others)), percent, size)
    return edges.unionByName(first), [large, texts, first, labelled]


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 90, size: int = SHINGLE, block: int = 96, block_shingles: int = 1 << 19, few: int = 6, max_sketch_bytes: int | None = None) -> DataFrame:
    """id, n_shingles, class_id (least id of an equal set) and component_id (least id reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))

    def make():
        def f(batch, data, offsets):
            rows, value = shingles(data, offsets, size)
            n = batch.num_rows
            d1, d2 = digests(rows, value, n)
            return np.bincount(rows, minlength=n), d1.view(np.int64), d2.view(np.int64)

        return f

    fields = [T.StructField(c, T.LongType()) for c in ("n_shingles", "d1", "d2")]
    sized = saved(with_columns(docs, "text", fields, make, needed=["doc"]), "sets", narrow=True)
    linkable = sized.where("doc IS NOT NULL AND n_shingles > 0")
    classes = saved(linkable.groupBy("d1", "d2").agg(F.min("doc").alias("class_id"), F.max("n_shingles").alias("n")), "classes")
    found = repeated_shingles(docs, size, max_sketch_bytes)
    large, repeated = found.sparse is not None, spark.sparkContext.broadcast(found)
    if large:
        swept(spark)
    comps = saved(components(candidate_edges(docs.where("doc IS NOT NULL"), percent, size, repeated)), "comps")
    released(repeated)
    if large:
        swept(spark)
    members = saved(classes.join(comps.select(F.col("node").alias("d1"), F.col("component").alias("comp")), "d1").select(F.col("class_id").alias("doc"), "comp", "n"), "members")
    links, read = linked(docs, members, percent, size, block, block_shingles, few)
    groups = saved(components(links), "groups")
    dropped(comps, members, *read)
    groups = groups.select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    of = classes.join(groups, "class_id", "left").select("d1", "d2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = sized.join(of, ["d1", "d2"], "left")
    none = F.col("n_shingles") == 0
    return out.select(F.col("doc").alias(id), "n_shingles", *(F.when(F.col("doc").isNull() | none, F.col("doc")).otherwise(F.col(c)).alias(c) for c in ("class_id", "component_id")))


def op3_jaccard_join(spark, sf_dir):
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) USING (doc_id)
"""
