"""Structured Streaming jobs: sessions over a stream, and snapshots of a folder whenever its change feed moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .rules import sessions


def session_stream(uses: DataFrame, late: str = "15 minutes", lifetime: str = "10 minutes") -> DataFrame:
    """Closed sessions of a stream (key, ts): a session is emitted once the watermark has passed its end; later uses are dropped."""
    return sessions(uses.withWatermark("ts", late), lifetime)


def index_on_change(feed: DataFrame, repository, checkpoint: str, now, memo: str = "stream", trigger: dict | None = None) -> StreamingQuery:
    """Index the repository's folder once for each batch of its change feed that has rows.

    `now` gives the milliseconds of a batch from its number. The snapshot id is derived from the batch number, so a batch
    that runs again after a failure names the same snapshot; an unchanged folder makes none.
    """
    import hashlib

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            repository.index(f"{memo} {number}", now(number), hashlib.sha1(f"{checkpoint} {number}".encode()).hexdigest())

    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
