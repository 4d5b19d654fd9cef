"""Bounded, repeatable samples of labelled texts for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved


def fold_of(id, folds: int):
    """The fold of an id: crc32 of it as text, modulo `folds`."""
    return F.crc32(id.cast("string").cast("binary")) % folds


def by_hash(ids: DataFrame, most: int) -> DataFrame:
    """The `most` rows of `ids` (id, label) with the smallest hash of the id, saved."""
    return saved(ids.orderBy(F.xxhash64("id"), "id").limit(most), "sample")


def texts(docs: DataFrame, sample: DataFrame, most: int, most_bytes: int) -> list[tuple[str, object]]:
    """(text, label) of the sampled ids, longest texts left out: on the driver, at most `most` rows of `most_bytes` bytes each,
    so `most` times `most_bytes` bounds what it holds.

    `docs` has id and text. The order is that of the ids, so fitting repeats exactly.
    """
    rows = docs.join(F.broadcast(sample), "id").where(F.octet_length("text") <= most_bytes)
    rows = rows.orderBy(F.xxhash64("id"), "id", "text").limit(most).select("text", "label")
    return [(r.text, r.label) for r in rows.collect()]
