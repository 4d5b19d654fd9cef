"""Count-min sketches of 64-bit hashes that saturate: which hashes may occur more than once, or at all.

Each task counts its hashes in chunks, one row of counters after the other, and emits the counters it touched as byte-coded
gaps, cut into slices; slices are merged by addition where they meet, and kept as one bit a counter: `least` or more.
Estimates are never too low. A task holds a chunk of hashes and one row's counters of it; a merging task a few slices.

Where so many counters would be too large to broadcast, hashes are counted in far more counters, which no task holds: each
chunk sends the numbers of those it touched, and only the numbers met again go into the broadcast, as a filter of ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, mix, trim
from .tables import dropped, saved

SLICE, CHUNK = 1 << 22, 1 << 20
ROWS = 2
COUNTERS_PER_BYTE, MAX_BYTES = 0.35, 96 << 20
SPARSE_SLICE_BITS, SPARSE_PER_BYTE = 24, 4


def gaps(index: np.ndarray) -> bytes:
    """Sorted distinct numbers as bytes: each gap is 255 as often as it fits, then the rest below 255."""
    if not len(index):
        return b""
    gap = np.diff(index, prepend=np.int64(-1)).astype(np.int64) - 1
    at = np.cumsum(gap // 255 + 1) - 1
    out = np.full(int(at[-1]) + 1, 255, np.uint8)
    out[at] = gap % 255
    return out.tobytes()


def ungaps(data: bytes) -> np.ndarray:
    code = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(code != 255)
    return np.cumsum(code, dtype=np.int64)[ends] + np.arange(len(ends))


def size_for(docs: DataFrame, counters_per_byte: float = COUNTERS_PER_BYTE, max_bytes: int = MAX_BYTES, merged_bytes: int = 64 << 20) -> tuple[int, int]:
    """(counters a row, spread) for the texts of `docs`. `max_bytes` of bits bound the broadcast; with so many first mergers a
    slice, each reads about `merged_bytes`, as a byte of text costs about 0.4 bytes of gaps."""
    return size_of(bytes_of(docs), counters_per_byte, max_bytes, merged_bytes)


def bytes_of(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def size_of(n_bytes: int, counters_per_byte: float, max_bytes: int, merged_bytes: int = 64 << 20) -> tuple[int, int]:
    width = bounded_width(n_bytes * counters_per_byte, max_bytes)
    slices = -(-ROWS * width // SLICE)
    return width, max(1, -(-int(0.4 * n_bytes) // (slices * merged_bytes)))


def bounded_width(wanted: float, max_bytes: int) -> int:
    return int(min(max(wanted, SLICE / 2), max_bytes * 8 / ROWS))


def counters(h: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The counter of each hash in each row of the sketch."""
    low, high = h & U(0xFFFFFFFF), h >> U(32)
    yield (low * U(width)) >> U(32)
    yield ((high * U(width)) >> U(32)) + U(width)


def passing(bits: np.ndarray | bytes, h: np.ndarray, width: int) -> np.ndarray:
    """Whether the bits of every counter of each hash are set."""
    bits = np.frombuffer(bits, np.uint8)
    out = np.ones(len(h), bool)
    for at in counters(h, width):
        out &= (bits[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1
    return out


def chunked(hashes: Iterator[np.ndarray], chunk: int | None = None) -> Iterator[np.ndarray]:
    """The same hashes in arrays of about `chunk`."""
    held, n, chunk = [], 0, chunk or CHUNK
    for h in hashes:
        held.append(h)
        n += len(h)
        if n >= chunk:
            joined = np.concatenate(held)
            held, n = [], 0
            yield joined
    if n:
        yield np.concatenate(held)


def counter_bits(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int, least: int = 2, spread: int = 1) -> bytes:
    """The bits of counters that are `least` (1 or 2) or more, over all hashes of `docs`.

    A slice's gaps are merged by `spread` tasks first, each of which hands on two bitmaps, so that the number of slices does not
    bound how many tasks share the work.
    """

    def local(batches):
        from pyspark import TaskContext

        bounds, salt = np.arange(0, ROWS * width + SLICE, SLICE), TaskContext.get().partitionId() % spread
        for h in chunked(hashes(batches)):
            for touched in counters(h, width):
                touched = touched.astype(np.uint32 if ROWS * width < 1 << 32 else np.int64)
                touched.sort()
                first = np.ones(len(touched), bool)
                first[1:] = touched[1:] != touched[:-1]
                once = touched[first]
                twice = np.diff(np.append(np.flatnonzero(first), len(touched))) > 1
                del touched, first
                cut, parts = np.searchsorted(once, bounds), []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    a, b = cut[k], cut[k + 1]
                    at = once[a:b].astype(np.int64) - bounds[k]
                    parts.append((k, salt, gaps(at), gaps(at[twice[a:b]]) if least > 1 else b""))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), kinds, strict=True)], names)
        trim()

    def merged(batches, bitmaps: bool):
        """(slice, counts up to 2) of each slice, from gaps or from bitmaps."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, once, twice in zip(*(batch.column(c) for c in ("slice", "once", "twice")), strict=True):
                count = held.setdefault(k.as_py(), np.zeros(SLICE, np.uint8))
                for part in (once, twice):
                    if bitmaps:
                        count += np.unpackbits(np.frombuffer(part.as_buffer(), np.uint8))
                        np.minimum(count, 2, out=count)
                    else:
                        at = ungaps(part.as_buffer())
                        count[at] = np.minimum(count[at] + 1, 2)
        yield from held.items()

    def merge_gaps(batches):
        for k, count in merged(batches, False):
            arrays = [pa.array([x], t) for x, t in zip((k, 0, np.packbits(count > 0).tobytes(), np.packbits(count > 1).tobytes()), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)
        trim()

    def merge(batches):
        for k, count in merged(batches, spread > 1):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(count >= least).tobytes()], pa.binary())], ["slice", "bits"])
        trim()

    names, kinds = ["slice", "salt", "once", "twice"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    touched = "slice int, salt int, once binary, twice binary"
    n, most = -(-ROWS * width // SLICE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(local, touched)
    if spread > 1:
        rows = rows.repartition(min(n * spread, most), "slice", "salt").mapInArrow(merge_gaps, touched)
    bits = np.zeros(n * SLICE // 8, np.uint8)
    # Saved first: read straight from the plan, an iterator would merge one partition after the other.
    table = saved(rows.repartition(min(n, most), "slice").mapInArrow(merge, "slice int, bits binary"), "sketch")
    for r in table.toLocalIterator():
        bits[r.slice * (SLICE // 8) : (r.slice + 1) * (SLICE // 8)] = np.frombuffer(r.bits, np.uint8)
    dropped(table)
    return bits.tobytes()


def sparse_counters(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> DataFrame:
    """counter: the numbers of the counters that are two or more, of 2**`bits` that count hashes by their first bits.

    A touched counter is three bytes in the shuffle; a merging task holds those of one slice, however many slices there are.
    """

    def local(batches):
        for h in chunked(hashes(batches)):
            at = h >> U(64 - bits)
            at.sort()
            few = np.ones(len(at), bool)
            few[2:] = at[2:] != at[:-2]  # two tell as much as more
            at = at[few]
            part = (at >> U(SPARSE_SLICE_BITS)).astype(np.int64)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            data = np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
            ends = np.append(first, len(at)).astype(np.int32) * 3
            blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), blobs], ["slice", "counters"])
        trim()

    def met_again(held, number):
        data = np.concatenate(held).reshape(-1, 3)
        at = data[:, 0] | data[:, 1].astype(np.uint32) << 8 | data[:, 2].astype(np.uint32) << 16
        at.sort()
        again = np.unique(at[1:][at[1:] == at[:-1]]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(again | number << SPARSE_SLICE_BITS)], ["counter"])

    def merge(batches):
        held, number = [], None
        for batch in batches:
            part, blobs = batch.column("slice").to_numpy(), batch.column("counters")
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for a, b in zip(first, [*first[1:], len(part)], strict=True):
                if held and part[a] != number:
                    yield met_again(held, number)
                    held = []
                number = part[a]
                held += [np.frombuffer(x.as_buffer(), np.uint8).copy() for x in blobs[a:b]]
        if held:
            yield met_again(held, number)
        trim()

    # A merging task's counters go on in chunks: a quarter of the usual tasks fills them better.
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    rows = docs.mapInArrow(local, "slice long, counters binary")
    return rows.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(merge, "counter long")


class IdFilter:
    """A Bloom filter of long ids, as a sketch of counters of one or more: never misses one, passes few others. `max_bytes` bounds it."""

    def __init__(self, ids: DataFrame, n: int, max_bytes: int):
        name = ids.columns[0]
        self.width = bounded_width(8 * n, max_bytes)
        self.bits = counter_bits(ids, lambda batches: (mix(b.column(name).drop_null().to_numpy().view(U)) for b in batches), self.width, least=1)

    def passes(self, ids: np.ndarray) -> np.ndarray:
        return passing(self.bits, mix(ids.astype(np.int64).view(U)), self.width)


class Repeats:
    """Which 64-bit hashes of `docs` may occur more than once: never misses one. `max_bytes` bounds the broadcast.

    Up to max_bytes * 4 / COUNTERS_PER_BYTE bytes of text the bits are of the counters themselves; beyond that a filter of the
    sparse counters that are two or more, so that hashes that occur once don't fill it.
    """

    def __init__(self, docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], max_bytes: int | None = None):
        n_bytes, max_bytes = bytes_of(docs), max_bytes or MAX_BYTES
        self.width, spread = size_of(n_bytes, COUNTERS_PER_BYTE, max_bytes)
        self.sparse = None
        if n_bytes * COUNTERS_PER_BYTE <= max_bytes * 8 / ROWS:
            self.bits = counter_bits(docs, hashes, self.width, spread=spread)
            return
        number = min(62, max(1, (SPARSE_PER_BYTE * n_bytes - 1).bit_length()))
        self.sparse = IdFilter(sparse_counters(docs, hashes, number), max_bytes, max_bytes)
        self.shift = 64 - number

    def passes(self, h: np.ndarray) -> np.ndarray:
        return passing(self.bits, h, self.width) if self.sparse is None else self.sparse.passes(h >> U(self.shift))


def sieve_of(spark, ids: DataFrame, n: int, max_bytes: int = 32 << 20) -> Callable[[str, bool], Callable] | None:
    """part(id, wanted): a map of Arrow batches to their rows whose long `id` is among the `n` of `ids` (one column) and few others,
    or to the rest, surely not among them. None where a filter of `max_bytes` has less than two bits an id: it would spare little."""
    if 2 * n > 8 * max_bytes:
        return None
    sieve = spark.sparkContext.broadcast(IdFilter(ids, n, max_bytes))

    def part(id: str, wanted: bool):
        def keep(batches):
            for batch in batches:
                column = batch.column(id)
                passed = sieve.value.passes(column.fill_null(0).to_numpy()) & column.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(passed == wanted))
            trim()

        return keep

    return part


def rows_of(df: DataFrame, id: str, ids: DataFrame, n: int, max_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame | None]:
    """`df` in two by `sieve_of`, for the map side of a join; without a sieve all rows are in the first part and the rest is None."""
    part = sieve_of(df.sparkSession, ids, n, max_bytes)
    if part is None:
        return df, None
    return df.mapInArrow(part(id, True), df.schema), df.mapInArrow(part(id, False), df.schema)
