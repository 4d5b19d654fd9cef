"""Rules on sessions, peers, discovery and leases. Each works on a batch; `sessions` and `discovery_buckets` also on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
LEASE_MS, LEASE_REFRESH_MS, LEASE_TRIES, LEASE_PAUSE_MS = 65_000, 30_000, 3, 5_000
PEER_STALE_MS, BUCKET_MS = 60_000, 300_000


def sessions(uses: DataFrame, lifetime: str = "10 minutes") -> DataFrame:
    """key, start, end, uses: a session lives for `lifetime` from its last use. A stream needs a watermark on ts first."""
    return uses.groupBy("key", F.session_window("ts", lifetime).alias("w")).agg(F.count("*").alias("uses")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "uses")


def staleness(sightings: DataFrame, now_ms: Column, after_ms: int = PEER_STALE_MS) -> DataFrame:
    """key, last_seen, stale."""
    return sightings.groupBy("key").agg(F.max("updated").alias("last_seen")).withColumn("stale", now_ms - F.col("last_seen") > after_ms)


def peer_counts(sightings: DataFrame, outbound: DataFrame, inbound: DataFrame, now_ms: Column, within_ms: int = PEER_STALE_MS) -> DataFrame:
    """One row: different peers seen lately, and different peers connected in either direction.

    A connection counts if it was used lately: an outbound one (key, expires, updated) whose token is still good, an inbound
    session (key, expires, updated) that is not past its end. "Lately" leaves the cutoff itself out. Null keys don't count.
    """
    lately = F.col("updated") > now_ms - within_ms
    seen = sightings.where(lately).agg(F.count_distinct("key").alias("seen"))
    live = outbound.where(lately & (now_ms < F.col("expires"))).select("key").unionByName(inbound.where(lately & ~(now_ms > F.col("expires"))).select("key"))
    return seen.crossJoin(live.agg(F.count_distinct("key").alias("connected")))  # one row each


def discovery_buckets(sightings: DataFrame, width_ms: int = BUCKET_MS) -> DataFrame:
    """key, bucket, sightings per discovery interval."""
    return sightings.withColumn("bucket", ((F.col("updated") - F.col("updated") % width_ms) / width_ms).cast("bigint")).groupBy("key", "bucket").agg(F.count("*").alias("sightings"))


def tag_accepted(bucket: Column, now_ms: Column, width_ms: int = BUCKET_MS) -> Column:
    """A discovery tag holds for its own interval and one to either side."""
    return F.abs(F.floor(now_ms / width_ms) - bucket) <= 1


def _runs(rows: DataFrame, gap_ms: int) -> DataFrame:
    """`rows` (lease, updated, ...) with `run`: rows of a lease in different runs lie more than `gap_ms` apart.

    A run is a stretch of buckets of `gap_ms` that all hold rows; they are numbered over the distinct buckets alone, so a lease
    with very many rows is neither sorted nor held as a whole.
    """
    bucketed = rows.withColumn("bucket", F.floor(F.col("updated") / gap_ms))
    buckets = bucketed.select("lease", "bucket").distinct()
    runs = buckets.withColumn("run", F.col("bucket") - F.row_number().over(Window.partitionBy("lease").orderBy("bucket")))
    same = F.col("b.lease").eqNullSafe(F.col("r.lease")) & (F.col("b.bucket") == F.col("r.bucket"))
    return bucketed.alias("b").join(runs.alias("r"), same).select(*(F.col(f"b.`{c}`") for c in rows.columns), "r.run")


def _folded(rows: DataFrame, gap_ms: int, order: list[str], kept: list[str], schema: str, start, step) -> DataFrame:
    """`kept` and what `step` adds to each row: (state, row) -> (state, values), over each run of a lease in order from `start()`.

    What a row gets hangs on what the rows before it got, which no window function tells; a run's rows come in sorted batches,
    and only the state is held.
    """
    columns = list(dict.fromkeys(["lease", "run", *order, *kept, *(c for c in rows.columns)]))
    dealt = _runs(rows, gap_ms).repartition("lease", "run").sortWithinPartitions("lease", "run", *order).select(*columns)
    out = T.StructType([dealt.schema[c] for c in kept] + T._parse_datatype_string(schema).fields)

    def fold(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, at, state = to_arrow_schema(out), None, None
        for batch in batches:
            added = []
            for row in batch.to_pylist():
                if at != (row["lease"], row["run"]):
                    at, state = (row["lease"], row["run"]), start()
                state, values = step(state, row)
                added.append(values)
            fields = list(arrow)[len(kept) :]
            values = zip(*added, strict=True) if added else [[] for _ in fields]
            new = [pa.array(v, f.type) for v, f in zip(values, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], schema=arrow)

    return dealt.mapInArrow(fold, out)


def lease_attempts(attempts: DataFrame) -> DataFrame:
    """lease, device, event_id, granted, of tries (lease, device, event_id, ts, updated) in order of ts and event_id.

    A lease is granted if it is free, if the device holds it, or if it was last granted more than its time ago. Only a grant
    writes the record: a try that is denied changes neither the holder nor the time.
    """

    def step(state, row):
        granted = state is None or state[0] == row["device"] or row["updated"] - state[1] > LEASE_MS
        return ((row["device"], row["updated"]) if granted else state), (granted,)

    return _folded(attempts, LEASE_MS, ["ts", "event_id"], ["lease", "device", "event_id"], "granted boolean", lambda: None, step)


def lease_requests(requests: DataFrame, most_ms: int) -> DataFrame:
    """lease, device, event_id, tries and granted_ms of requests (lease, device, event_id, updated, hold_ms, released).

    A request tries up to three times, five seconds apart, and gives up after the last; `granted_ms` is null then. The holder
    refreshes the record every 30 seconds for `hold_ms` (at most `most_ms`) and then releases the lease, or, where `released`
    is false, stops without: the lease is free once the last refresh is older than its time. A holder's own request is granted
    and starts its hold anew. Tries at one time go by event_id.
    """
    if most_ms < 0:
        raise ValueError("most_ms is below 0")
    number = F.explode(F.sequence(F.lit(0), F.lit(LEASE_TRIES - 1)))
    tries = requests.withColumn("number", number).withColumn("updated", F.col("updated") + F.col("number") * LEASE_PAUSE_MS)
    tries = tries.withColumn("hold_ms", F.least(F.greatest("hold_ms", F.lit(0)), F.lit(most_ms)))

    def step(state, row):
        # held: (device, free from); done: requests under way and how far they are.
        held, done = state
        x = row["updated"]
        if row["event_id"] in done:
            done.discard(row["event_id"])
            if row["number"] < LEASE_TRIES - 1:
                done.add(row["event_id"])
            return state, (None,)
        if held is None or held[0] == row["device"] or x >= held[1]:
            until = x + row["hold_ms"] if row["released"] else x + row["hold_ms"] // LEASE_REFRESH_MS * LEASE_REFRESH_MS + LEASE_MS + 1
            if row["number"] < LEASE_TRIES - 1:
                done.add(row["event_id"])
            return ((row["device"], until), done), (True,)
        return state, (False,)

    gap = most_ms + LEASE_MS + LEASE_TRIES * LEASE_PAUSE_MS
    tries = tries.select("lease", "device", "event_id", "updated", "hold_ms", "released", "number")
    kept, order = ["lease", "device", "event_id", "updated", "number"], ["updated", "event_id", "number"]
    rows = _folded(tries, gap, order, kept, "granted boolean", lambda: (None, set()), step)
    tried = rows.where("granted IS NOT NULL").groupBy("lease", "device", "event_id")
    return tried.agg(F.count("*").alias("tries"), F.max(F.when(F.col("granted"), F.col("updated"))).alias("granted_ms"))
