"""Leases and peers against row-by-row restatements of their rules."""

import random

from pyspark.sql import functions as F

from palimpsest.streaming import rules

TRY = "lease string, device string, event_id long, ts timestamp_ntz, updated long"


def tries(spark, rows):
    df = spark.createDataFrame(rows, "lease string, device string, event_id long, updated long")
    return df.withColumn("ts", F.timestamp_millis("updated").cast("timestamp_ntz"))


def test_a_denied_try_does_not_hold_the_lease(spark):
    rows = [("l", "A", 1, 0), ("l", "B", 2, 30_000), ("l", "B", 3, 40_000), ("l", "C", 4, 70_000)]
    got = rules.lease_attempts(tries(spark, rows)).orderBy("event_id").collect()
    assert [r.granted for r in got] == [True, False, False, True]


def test_lease_bounds(spark):
    rows = [("l", "A", 1, 0), ("l", "B", 2, 65_000), ("l", "B", 3, 65_001), ("m", "B", 4, 10), (None, "A", 5, 0), (None, None, 6, 1), (None, None, 7, 70_000)]
    got = {r.event_id: r.granted for r in rules.lease_attempts(tries(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: True}
    assert rules.lease_attempts(tries(spark, rows).where("false")).isEmpty()


def test_leases_against_brute_force(spark):
    r = random.Random(4)
    rows, at = [], 0
    for n in range(3000):
        at += r.choice((0, 1, 4_000, 20_000, 64_999, 65_000, 65_001, 130_001))
        rows.append((r.choice("lmn"), r.choice("ABC"), n, at))
    want, held = {}, {}
    for lease, device, n, t in rows:
        holder, since = held.get(lease, (None, 0))
        want[n] = holder in (None, device) or t > since + 65_000
        if want[n]:
            held[lease] = (device, t)
    got = {x.event_id: x.granted for x in rules.lease_attempts(tries(spark, rows).repartition(5)).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def simulated(requests):
    """Requests one by one over a clock: (tries, granted_ms) of each."""
    events = sorted((t + 5000 * k, n, k) for n, (_, _, t, _, _) in enumerate(requests) for k in range(3))
    out, record = {n: [0, None] for n in range(len(requests))}, {}
    for at, n, _ in events:
        lease, device, _, hold, released = requests[n]
        if out[n][1] is not None:
            continue
        out[n][0] += 1
        holder = record.get(lease)  # device, last refresh, released at
        if holder is not None:
            who, begun, length, gives = holder
            last = min(at, begun + length)
            refreshed = begun + (last - begun) // 30_000 * 30_000
            if (gives and at >= begun + length) or at > refreshed + 65_000:
                holder = None
        if holder is None or holder[0] == device:
            record[lease] = (device, at, hold, released)
            out[n][1] = at
    return {n: tuple(v) for n, v in out.items()}


def test_lease_requests_against_a_simulation(spark):
    r = random.Random(11)
    requests, at = [], 0
    for _ in range(1500):
        at += r.choice((0, 1_000, 5_000, 9_000, 31_000, 70_000, 400_000))
        requests.append((r.choice("lm"), r.choice("ABCD"), at, r.choice((0, 10_000, 29_999, 30_000, 30_001, 90_000)), r.random() < 0.7))
    rows = [(lease, d, n, t, hold, released) for n, (lease, d, t, hold, released) in enumerate(requests)]
    df = spark.createDataFrame(rows, "lease string, device string, event_id long, updated long, hold_ms long, released boolean").repartition(3)
    got = {x.event_id: (x.tries, x.granted_ms) for x in rules.lease_requests(df, 90_000).collect()}
    assert got == simulated(requests)
    assert {x[0] for x in got.values()} == {1, 2, 3} and any(x[1] is None for x in got.values())


def test_peers_seen_and_connected(spark):
    now, c = 10_000_000, "key string, expires long, updated long"
    out = spark.createDataFrame([("stale", now + 60_000, now - 120_000), ("fresh", now + 60_000, now), ("ended", now, now), ("edge", now + 1, now - 60_000)], c)
    inside = spark.createDataFrame([("old", now + 60_000, now - 120_000), ("here", now + 60_000, now), ("fresh", now, now - 59_999), ("past", now - 1, now)], c)
    r = rules.peer_counts(out.unionByName(inside).union(out.where("false")), out, inside, F.lit(now)).first()
    assert (r.seen, r.connected) == (4, 2)  # fresh, ended, here, past; fresh, here
    r = rules.peer_counts(out.where("false"), out.where("false"), inside.where("false"), F.lit(now)).first()
    assert (r.seen, r.connected) == (0, 0)


def test_discovery_tags_hold_for_a_neighbouring_interval(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "bucket long")
    got = {r.bucket for r in rows.where(rules.tag_accepted(F.col("bucket"), F.lit(3 * 300_000 + 17))).collect()}
    assert got == {2, 3, 4}
