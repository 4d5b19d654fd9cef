"""Vectorised word kernels over Arrow text columns, and the helper that appends columns in Arrow batches.

A block of texts is one byte array with document offsets. Words are maximal runs of bytes that a 256-entry table maps
to a non-zero byte; the table also folds case. Every word gets a 64-bit hash in a fixed number of numpy passes, with no
Python loop over words. Texts are handled whole: a block holds at most BLOCK_BYTES, or one longer text. Hashing goes over
a block in pieces of PIECE bytes, so what a long text takes is three bytes a byte and some fifty a word, for the places and hashes of its words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BLOCK_BYTES, PIECE = 1 << 19, 1 << 18
U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int) -> np.ndarray:
    """The first PIECE + 1 powers of `base`."""
    if base not in _powers:
        steps = np.full(PIECE + 1, base, U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def span_hashes(codes: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span, by the weight of each code; spans are in order and don't overlap."""
    value, scale = np.zeros(len(starts), U), np.zeros(len(starts), U)
    up, down = powers(_BASE), powers(_INVERSE)
    carry, high, low = 0, 1, 1  # the sum up to the piece; the base and its inverse to the power of its place
    for at in range(0, len(codes), PIECE):
        piece = codes[at : at + PIECE]
        total = np.empty(len(piece) + 1, U)
        total[0] = 0
        np.cumsum(weights[piece] * up[: len(piece)], out=total[1:])
        total = total * U(high) + U(carry)
        a, b = np.searchsorted(starts, [at, at + len(piece)])
        place = starts[a:b] - at
        value[a:b], scale[a:b] = U(0) - total[place], down[place] * U(low)
        a, b = np.searchsorted(ends, [at, at + len(piece)], "right")
        value[a:b] += total[ends[a:b] - at]
        carry = int(total[-1])
        high, low = high * pow(_BASE, len(piece), 1 << 64) & _MASK, low * pow(_INVERSE, len(piece), 1 << 64) & _MASK
    value *= scale
    del scale
    value ^= (ends - starts).astype(U)
    return mix(value)


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and what they keep counts for the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(None)


def word_table(separators: bytes, fold: bool) -> np.ndarray:
    """Byte -> byte inside words (A-Z folded to a-z on request), 0 for separators."""
    table = np.arange(256, dtype=np.uint8)
    if fold:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: Words of anything but ASCII white space; NUL is a word byte there, so it is mapped to 255, which no UTF-8 text has.
SPACED, SPACED_FOLDED = word_table(b"\x20\x09\x0a\x0b\x0c\x0d", False), word_table(b"\x20\x09\x0a\x0b\x0c\x0d", True)
SPACED[0] = SPACED_FOLDED[0] = 255
#: Words of ASCII letters and digits and of everything outside ASCII.
ALNUM_FOLDED = word_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row's begin (one more entry than rows). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `size` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, rows)
        row = end


class Words:
    """The words of a block: starts and ends in `data`, the row of each, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.folded = table[data]
        inside = self.folded != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] |= inside[edges]
        last[edges - 1] |= inside[edges - 1]
        del inside
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        del first, last
        self.firsts = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.firsts)
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.folded, _LETTERS, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.folded[self.starts[i] : self.ends[i]].tobytes()


def windows(h: np.ndarray, words: int, multiplier: int) -> np.ndarray:
    """A hash of each `words` consecutive word hashes."""
    n = len(h) - words + 1
    if n <= 0:
        return np.zeros(0, U)
    total = h[:n].copy()
    for j in range(1, words):
        total *= U(multiplier)
        total += h[j : j + n]
    return mix(total)


def row_blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text bytes and offsets; memory is given back after the last one."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        for a, b in blocks(offsets, size):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        batch = data = offsets = None
    trim()


def with_columns(df: DataFrame, text: str, fields: list[StructField], make: Callable[[], Callable], needed: list[str] | None = None, size: int = BLOCK_BYTES, only: Callable | None = None) -> DataFrame:
    """`df`'s columns (or `needed`) and new ones, computed in Arrow blocks. A column of `df` that has a new one's name gives way.

    `make()` runs once in each task and returns f(block, data, offsets) -> the new columns as Arrow arrays. `only` maps the batches
    to those of the rows to keep in the same worker: a second mapInArrow in the stage would take another worker for each task.
    """
    new = StructType(fields)
    used = [c for c in (needed if needed is not None else df.columns) if c not in new.names]
    names = list(dict.fromkeys([*used, text]))
    # Numbered names on the way: a column may have a dot or a space in its name.
    source = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, f = to_arrow_schema(out), make()
        batches = (b.rename_columns(names) for b in batches)
        for block, data, offsets in row_blocks(only(batches) if only else batches, text, size):
            made = f(block, data, offsets)
            arrays = [pa.array(x, t.type) if not isinstance(x, pa.Array) else x.cast(t.type) for x, t in zip(made, list(schema)[len(used) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*block.columns[: len(used)], *arrays], schema=schema)

    out = StructType([StructField(f"c{k}", source.schema[k].dataType) for k in range(len(used))] + [StructField(f"n{k}", f.dataType) for k, f in enumerate(new.fields)])
    return source.mapInArrow(run, out).toDF(*used, *new.names)
