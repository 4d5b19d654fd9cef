"""Document fingerprints: homomorphic multiset hashes of paragraphs. DataFrame functions only.

A text's units are its paragraphs (ended by newlines), cut at spaces after punctuation so that short texts have several. Each
unit is hashed into wide vectors, and a fingerprint is the sum of its units' vectors, lane by lane modulo a power of two:

* 126 narrow lanes modulo 2**20, one hash bit each: three lanes to a long, with a guard bit between them;
* 8 wide lanes modulo 2**32, for equality: 256 bits;
* the number of units modulo 2**32.

Sums don't depend on the order of units; a unit is added or removed by adding or subtracting its vector (`inserted`,
`deleted`). Narrow lanes, read as sums of +1 and -1, estimate inner products of the multisets (a tug-of-war sketch); likeness is the
normalised inner product, with a standard error of about an eighth.

The next document in ascending doc_id is found without a global sort: bounds between about equal numbers of ids are read
from the ids alone, rows go to their bucket in one shuffle, and the first row of each bucket also goes, as a guest, to the
bucket before it (the first of all to the last).

Defined results: a null text is empty; an empty text has no units and the zero fingerprint; two empty texts have likeness
1. A null doc_id comes first; equal doc_ids are ordered by text, and lie in one bucket. With one document, the next one is
itself; an empty table gives an empty one. Repeated rows are fingerprinted row by row; `with_next` adds columns whose names
begin with two underscores on the way, so those of its input must not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NARROW, WIDE = 21, 4
_ONES = 1 | 1 << 21 | 1 << 42
_LANES = _ONES * ((1 << 20) - 1)
_LOW32 = (1 << 32) - 1
#: How unlike seeds are told apart: hashed before the unit.
_SEEDS = (11, 23, 37, 53, 71, 97)


def units(text):
    """Units of a text; blank ones don't count."""
    # At a newline, or at a space with a mark before it: what lies behind is looked at where one of the two is, not everywhere.
    return F.filter(F.split(text, r"[\n\x20](?:(?<=\n)|(?<=[^\p{L}\p{N}\s]\x20))"), lambda u: F.trim(u) != "")


def _longs(values):
    return F.array(*(F.lit(v).cast("long") for v in values))


def _sum(hashes, steps, part, mask):
    """Per step, the sum of h >> step, cut down to `part`, over the hashes h, modulo `mask`."""
    zeros, part, mask = _longs([0] * len(steps)), F.lit(part).cast("long"), F.lit(mask).cast("long")
    # shiftright takes its distance as an expression only in SQL form.
    add = lambda t, j, h: (t + F.call_function("shiftright", h, j).bitwiseAND(part)).bitwiseAND(mask)
    return F.aggregate(hashes, zeros, lambda total, h: F.zip_with(total, F.array(*map(F.lit, steps)), lambda t, j: add(t, j, h)))


def _bits(hashes):
    return _sum(hashes, range(NARROW), _ONES, _LANES)


def _halves(hashes):
    return _sum(hashes, (0, 32), _LOW32, _LOW32)


def _seeded(seed: int):
    return lambda unit: F.xxhash64(F.lit(seed), unit)


def fingerprint(of):
    """The fingerprint of an array of units: longs, 42 with narrow lanes, 8 wide, 1 count."""
    hashed = [F.transform(of, _seeded(s)) for s in _SEEDS]
    return F.concat(*(_bits(h) for h in hashed[:2]), *(_halves(h) for h in hashed[2:]), F.array(F.size(of).cast("long").bitwiseAND(F.lit(_LOW32).cast("long"))))


def _each(a, b, sign: int):
    """a + b or a - b, lane by lane. The guard bits take what a lane borrows or carries."""
    masks = _longs([_LANES] * 2 * NARROW + [_LOW32] * (2 * WIDE + 1))
    guards = _longs([_ONES << 20] * 2 * NARROW + [1 << 32] * (2 * WIDE + 1))
    joined = F.zip_with(a, F.zip_with(b, guards, lambda y, g: F.struct(y.alias("y"), g.alias("g"))), lambda x, p: x + p["y"] if sign > 0 else x.bitwiseOR(p["g"]) - p["y"])
    return F.zip_with(joined, masks, lambda x, m: x.bitwiseAND(m))


def inserted(a, b):
    """The fingerprint of the units of a and b together."""
    return _each(a, b, 1)


def deleted(a, b):
    """The fingerprint of a's units less b's."""
    return _each(a, b, -1)


def shown(f):
    """A fingerprint as lower-case hex."""
    return F.lower(F.concat_ws("", F.transform(f, lambda x: F.lpad(F.hex(x), 16, "0"))))


def _dot(a, b):
    """Sum of products of the narrow lanes of two fingerprints."""
    lane = F.lit((1 << 20) - 1).cast("long")
    product = lambda x, y, s: F.shiftright(x, s).bitwiseAND(lane) * F.shiftright(y, s).bitwiseAND(lane)
    products = F.zip_with(F.slice(a, 1, 2 * NARROW), F.slice(b, 1, 2 * NARROW), lambda x, y: product(x, y, 0) + product(x, y, 21) + product(x, y, 42))
    return F.aggregate(products, F.lit(0).cast("long"), lambda t, x: t + x)


def moments(f):
    """n, the number of units; sum and square, of the narrow lanes: what `likeness` needs of each side alone."""
    lane = F.lit((1 << 20) - 1).cast("long")
    lanes = lambda x: x.bitwiseAND(lane) + F.shiftright(x, 21).bitwiseAND(lane) + F.shiftright(x, 42).bitwiseAND(lane)
    total = F.aggregate(F.slice(f, 1, 2 * NARROW), F.lit(0).cast("long"), lambda t, x: t + lanes(x))
    return F.struct(F.element_at(f, -1).alias("n"), total.alias("sum"), _dot(f, f).alias("square"))


def likeness(a, b, of_a=None, of_b=None):
    """2 <a, b> / (<a, a> + <b, b>) of the unit counts as vectors, estimated by the narrow lanes, from 0 to 1; 1 for equal fingerprints.

    Where no unit repeats, that is the part of all units that the two texts share. A lane x of n units stands for 2 x - n; sums over
    lanes are exact in longs. `of_a` and `of_b` are columns of `moments`, where they are at hand.
    """
    p, q = (moments(f) if m is None else m for f, m in ((a, of_a), (b, of_b)))
    n, m, lanes = p["n"], q["n"], 6 * NARROW
    own = lambda x: 4 * x["square"] - 4 * x["n"] * x["sum"] + lanes * x["n"] * x["n"]
    both = (own(p) + own(q)).cast("double")
    shared = (4 * _dot(a, b) - 2 * m * p["sum"] - 2 * n * q["sum"] + lanes * n * m).cast("double")
    near = F.when(both > 0, 2 * shared / both).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), near))


def with_next(docs: DataFrame, id: str, values: list[str], order: list[str], buckets: int | None = None) -> DataFrame:
    """`docs` with next_<value> of the row that follows by (id, order...), cyclically."""
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id).alias("id")).where(F.col(id).isNotNull())
    bounds = sorted(set(ids.agg(F.percentile_approx("id", [(k + 1) / n for k in range(n - 1)], 20 * n)).first()[0] or [])) if n > 1 else []
    # The number of bounds below the id, by binary search in a constant array; a null id falls in the first bucket.
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length())))) if bounds else F.array(F.lit(1))
    array = F.array(*(F.lit(b).cast(docs.schema[id].dataType) for b in [*bounds, None]))
    bucket = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(array, low + step - 1) < F.col(id), low + step).otherwise(low))
    placed = docs.withColumn("__bucket", bucket)
    least = F.min(F.struct(F.col(id).isNotNull().alias("some"), F.col(id).alias("id")))
    first = {r.b: r.least.id for r in placed.groupBy(F.col("__bucket").alias("b")).agg(least.alias("least")).collect()}
    taken = sorted(first)
    before = {b: taken[k - 1] for k, b in enumerate(taken)}
    every = range(len(bounds) + 1)
    ids, to = F.array(*(F.lit(first.get(b)).cast(docs.schema[id].dataType) for b in every)), F.array(*(F.lit(before.get(b)).cast("int") for b in every))
    placed = placed.withColumn("__to", F.when(F.get(ids, F.col("__bucket")).eqNullSafe(F.col(id)), F.get(to, F.col("__bucket"))))
    own, sent = F.struct(F.col("__bucket").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("__to").alias("at"), F.lit(1).alias("guest"))
    dealt = placed.withColumn("__place", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, sent))))
    dealt = dealt.withColumn("__at", F.col("__place.at")).withColumn("__guest", F.col("__place.guest"))
    w = Window.partitionBy("__at").orderBy("__guest", F.col(id).asc_nulls_first(), *order)
    return dealt.select("*", *(F.lead(v).over(w).alias(f"next_{v}") for v in values)).where("__guest = 0").drop("__bucket", "__to", "__place", "__at", "__guest")


def op7_fingerprint(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = docs.withColumn("u", units(F.col("text"))).withColumn("f", fingerprint(F.col("u"))).withColumn("m", moments(F.col("f"))).drop("u")
    both = with_next(own, "doc_id", ["text", "f", "m"], ["text"]).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 4).cast("int")
    text = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - k).cast("int")), F.substring("next_text", F.lit(1), k))
    edited = both.withColumn("edited", text).withColumn("eu", units(F.col("edited")))
    done = edited.withColumn("ef", fingerprint(F.col("eu"))).withColumn("em", moments(F.col("ef")))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("f")).alias("fingerprint"),
        shown(F.col("ef")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("ef"), F.col("m"), F.col("em")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_f"), F.col("m"), F.col("next_m")).alias("near_next"),
    )
