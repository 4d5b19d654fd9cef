"""Quality classifier by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Features are hashed n-grams (1 and 2) of words, and of word forms: what a word looks like rather than what it says, its case,
its last two marks, whether it repeats the word before it, and whether it has letters. For each of the two, the raw model
counts the n-grams of all documents, the target model those of documents labelled good. A document's log weight is the sum
over its n-grams of the log ratios, as under a bag-of-n-grams model.

Such sums grow with length, far beyond any noise, so they are calibrated: a logistic model of the two mean log ratios an n-gram,
fitted on labelled documents that the target model has not counted, gives the log odds that a document is good.

Selection: the `k` largest of log odds / temperature + Gumbel noise, a sample without replacement with odds given by the
weights: documents that are surely good or bad are hardly touched by the draw, doubtful ones are taken in proportion. The
noise is a hash of (seed, id), so a recomputed task draws the same. By default k is the number of documents with even odds or
better. The k-th largest key is found exactly by refining a histogram of its 64 bits, 16 at a time; documents with equal keys
at the cut are all kept.

Scale: two narrow passes over the text. The first counts, and gathers the n-grams of labelled rows; the models meet as at most
`buckets` sums. The second writes each row with its key, and the result reads that table. The labels are a sample of at most
`max_labelled` ids, the smallest by hash; the raw model covers every document.

Defined results: a null or empty text has log weight 0 and is judged by the odds of that; repeated rows, equal texts of one id
and all rows of null ids share a draw; ties at the cut are all kept; of several texts of one labelled id, calibration reads one.
Without labels of both kinds, in either part, every document has log odds 0 and all are kept. An empty table gives an
empty one. Columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import SPACED, SPACED_FOLDED, U, Words, mix, row_blocks, with_columns
from .tables import dropped, released, saved
from .toxicity import logistic

FORMS, WORDS, TEMPERATURE, SEED, MAX_LABELLED = 8192, 16384, 1.0, 20240611, 20_000


def _with_pairs(h: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of single hashes and of neighbouring pairs in a row."""
    inside = rows[1:] == rows[:-1]
    pair = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])
    return np.concatenate([rows, rows[1:][inside]]), (np.concatenate([h, pair[inside]]) % U(buckets)).astype(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray, forms: int = FORMS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams of word forms, in buckets from 0, and of words, in those from `forms` on."""
    spaced = Words(data, offsets, SPACED)
    n = len(spaced.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int32)])
    lower = np.concatenate([[0], np.cumsum(((data >= 97) & (data <= 122)) | (data >= 128), dtype=np.int32)])
    up, low = upper[spaced.ends] - upper[spaced.starts], lower[spaced.ends] - lower[spaced.starts]
    case = np.where(up + low == 0, 0, np.where(up == 0, 1, np.where((up > 1) & (up >= low), 2, 3)))
    mark = np.where(((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128), np.uint8(0), data)
    last, prior = mark[spaced.ends - 1], np.where(spaced.ends - spaced.starts > 1, mark[np.maximum(spaced.ends - 2, 0)], 0)
    h = spaced.hashes()
    again = np.zeros(n, np.int64)
    again[1:] = (h[1:] == h[:-1]) & (spaced.rows[1:] == spaced.rows[:-1])
    form = mix((case | last.astype(np.int64) << 8 | prior.astype(np.int64) << 16 | again << 24).astype(U) + U(1))
    row, bucket = _with_pairs(form, spaced.rows, forms)
    _, other = _with_pairs(Words(data, offsets, SPACED_FOLDED).hashes(), spaced.rows, words)
    return np.concatenate([row, row]), np.concatenate([bucket, other + forms])


#: What the first pass gives: counts of a bucket, or, in bucket -1, the n-grams of a labelled row under the hash of its id.
COUNTED = "bucket int, id long, n long, n_good long, good int, grams binary"


def _counted(docs: DataFrame, forms: int, words: int) -> DataFrame:
    """COUNTED of `docs` (id, text, good, part): parts 0 and 1 with good = 1 are the target, part 2 is gathered."""

    def count(batches):
        total = np.zeros((2, forms + words), np.int64)
        for block, data, offsets in row_blocks(batches, "text"):
            rows, bucket = grams(data, offsets, forms, words)
            good = block.column("good").fill_null(-1).to_numpy()
            part = block.column("part").to_numpy()
            total[0] += np.bincount(bucket, minlength=forms + words)
            total[1] += np.bincount(bucket[((good == 1) & (part < 2))[rows]], minlength=forms + words)
            gathered = (good >= 0) & (part == 2)
            if gathered.any():
                own = gathered[rows]
                order = np.argsort(rows[own], kind="stable")
                sorted_bucket, cut = bucket[own][order].astype(np.int32), np.searchsorted(rows[own][order], np.arange(len(good) + 1))
                held = [sorted_bucket[cut[i] : cut[i + 1]].tobytes() for i in np.flatnonzero(gathered)]
                kept, m = block.filter(pa.array(gathered)), len(held)
                yield pa.RecordBatch.from_arrays([pa.array([-1] * m, pa.int32()), kept.column("id"), pa.array([0] * m), pa.array([0] * m), kept.column("good"), pa.array(held, pa.binary())], names)
        used = np.flatnonzero(total[0])
        m = len(used)
        numbers = [used.astype(np.int32), np.zeros(m, np.int64), total[0][used], total[1][used]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)

    names = [x.split()[0] for x in COUNTED.split(", ")]
    rows = docs.select("id", "text", "good", "part").mapInArrow(count, COUNTED)
    sums = [F.sum("n").alias("n"), F.sum("n_good").alias("n_good"), F.max("good").alias("good"), F.min("grams").alias("grams")]
    return rows.groupBy("bucket", "id").agg(*sums).select(*names)


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Per bucket, log of target over raw probability, with one count added to each bucket that occurs."""
    raw, target = counts
    if not target.sum():
        return np.zeros(len(raw))
    seen = raw > 0
    p = (target + 1) / (target.sum() + seen.sum())
    q = (raw + 1) / (raw.sum() + seen.sum())
    return np.where(seen, np.log(p / q), 0.0)


class Odds:
    """Log ratios of buckets, and log odds as a line in the mean log ratios of forms and of words."""

    def __init__(self, ratio: np.ndarray, forms: int):
        self.ratio, self.forms, self.line = ratio, forms, np.zeros(3)

    def sums(self, rows: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Per row: the sums of log ratios of forms and of words, and the number of n-grams of each."""
        form = bucket < self.forms
        value = self.ratio[bucket]
        return np.stack([np.bincount(rows[form], value[form], n), np.bincount(rows[~form], value[~form], n), np.bincount(rows[form], minlength=n)])

    def means(self, sums: np.ndarray) -> np.ndarray:
        return (sums[:2] / np.maximum(sums[2], 1)).T

    def fit(self, means: np.ndarray, good: np.ndarray) -> None:
        """Logistic regression on standardised means; a mean that would count against good documents is left out."""
        centre, spread = means.mean(axis=0), means.std(axis=0) + 1e-9
        x = (means - centre) / spread
        w = logistic(x, good, ridge=1.0)
        if w[1:].min() < 0:
            x[:, w[1:].argmin()] = 0
            w = np.maximum(logistic(x, good, ridge=1.0), [-np.inf, 0, 0])
        self.line = np.array([w[0] - (w[1:] * centre / spread).sum(), *(w[1:] / spread)])

    def of(self, sums: np.ndarray) -> np.ndarray:
        return self.line[0] + self.means(sums) @ self.line[1:]


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, forms: int = FORMS, words: int = WORDS, max_labelled: int = MAX_LABELLED) -> Odds:
    """The models of `docs` and of its labelled part, and their calibration."""
    sample = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.xxhash64(id).alias("id")).agg(F.min(label).cast("int").alias("good"))
    sample = saved(sample.orderBy("id").limit(max_labelled), "labels")
    keyed = docs.select(F.when(F.col(id).isNotNull(), F.xxhash64(id)).alias("id"), F.col(text).alias("text"))
    labelled = keyed.join(F.broadcast(sample), "id", "left").withColumn("part", F.coalesce(F.pmod("id", F.lit(3)), F.lit(0)).cast("int"))
    counted = saved(_counted(labelled, forms, words), "counted")
    counts = np.zeros((2, forms + words))
    for r in counted.where("bucket >= 0").select("bucket", "n", "n_good").collect():  # a row a bucket at most
        counts[:, r.bucket] = r.n, r.n_good
    odds = Odds(np.concatenate([log_ratio(counts[:, :forms]), log_ratio(counts[:, forms:])]), forms)

    def means(batches):
        for batch in batches:
            for grams, good in zip(batch.column("grams"), batch.column("good").to_numpy(), strict=True):
                bucket = np.frombuffer(grams.as_buffer(), np.int32)
                x, y = odds.means(odds.sums(np.zeros(len(bucket), np.int64), bucket, 1))[0].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([y]), pa.array([int(good)])], ["x", "y", "good"])

    rows = counted.where("bucket < 0").select("grams", "good").mapInArrow(means, "x double, y double, good long").collect()  # max_labelled rows at most
    rows.sort()
    good = np.array([r.good for r in rows], float)
    if 0 < good.sum() < len(good) and counts[1].any():
        odds.fit(np.array([(r.x, r.y) for r in rows]), good)
    dropped(sample, counted)
    return odds


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest long of column `key`; None if there are fewer."""
    low, left = None, k
    for shift in (48, 32, 16, 0):
        part = keys if low is None else keys.where(F.shiftright("key", shift + 16) == low)
        bins = part.groupBy(F.shiftright("key", shift).alias("b")).count().orderBy(F.desc("b")).collect()  # 65,536 rows at most
        for r in bins:
            if left <= r["count"]:
                low = r.b
                break
            left -= r["count"]
        else:
            return None
    return low


def _sortable(x):
    """Doubles as longs in the same order, by their bits: scaled to fixed point, as keys span a known range."""
    return F.round(F.greatest(F.lit(-4e9), F.least(F.lit(4e9), x)) * F.lit(float(1 << 30))).cast("long")


def noise(id, seed: int):
    """Standard Gumbel noise, a function of the id alone."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    k: int | None = None,
    columns: list[str] | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    **options,
) -> DataFrame:
    """__row (a struct of `docs`' columns, or of `columns`), log_weight, n_words, log_odds and selected."""
    odds = fit(docs, labels, id, text, label, **options)
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    def make():
        own = shared.value

        def block(batch, data, offsets):
            n = batch.num_rows
            sums = own.sums(*grams(data, offsets, own.forms, len(own.ratio) - own.forms), n)
            return sums[0] + sums[1], (sums[2].astype(np.int64) + 1) // 2, own.of(sums)

        return block

    fields = [T.StructField("log_weight", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("log_odds", T.DoubleType())]
    names = columns or docs.columns
    place = {c: f"c{k}" for k, c in enumerate(names)}
    other = [] if text in place else [F.col(text).alias("text")]
    # The text goes to Python once, as one of the columns, and into the struct after that.
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in place.items()), noise(F.col(id), seed).alias("noise"), *other)
    scored = with_columns(rows, place.get(text, "text"), fields, make, needed=[*place.values(), "noise"])
    key = _sortable(F.col("log_odds") / temperature + F.col("noise")).alias("key")
    row = F.struct(*(F.col(n).alias(c) for c, n in place.items())).alias("__row")
    keyed = saved(scored.select(row, "log_weight", "n_words", "log_odds", key), "keys", narrow=columns is not None)
    released(shared)
    if not odds.line.any():
        return keyed.drop("key").withColumn("selected", F.lit(True))
    k = keyed.agg(F.count_if(F.col("log_odds") >= 0)).first()[0] if k is None else k
    least = kth_largest(keyed.select("key"), k) if k else None
    chosen = F.lit(k > 0) if least is None else F.col("key") >= least
    return keyed.withColumn("selected", chosen).drop("key")


def keep_selected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the sample takes."""
    return resample(docs, labels, **options).where("selected").select("__row.*")


def op10_quality(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs.select("doc_id", "text"), labels, columns=["doc_id"]).select("__row.doc_id", "n_words", "log_weight", "log_odds", "selected")
