"""Chunking: lines for text, a rolling hash for bytes; dedup and reassembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The polynomial, and the window and bounds of its chunker.
POLYNOMIAL = 0x3DA3358B4DC173
LEAST, MOST, BITS, WINDOW = 512 << 10, 8 << 20, 20, 64


def exploded(files: DataFrame) -> DataFrame:
    """path, pos, line, chunk_id."""
    return files.select("path", F.posexplode(F.arrays_zip("lines", "chunks")).alias("pos", "c")).select("path", "pos", F.col("c.lines").alias("line"), F.col("c.chunks").alias("chunk_id"))


def store(pieces: DataFrame) -> DataFrame:
    """chunk_id, data, size: each different chunk once."""
    return pieces.groupBy("chunk_id").agg(F.first("line").alias("data")).select("chunk_id", "data", F.octet_length("data").cast("bigint").alias("size"))


def dedup_stat(pieces: DataFrame) -> DataFrame:
    """One row: chunks and bytes before and after dedup. Aggregated by chunk first, so no distinct runs over raw rows."""
    per = pieces.groupBy("chunk_id").agg(F.count("*").alias("n"), F.first(F.octet_length("line")).cast("bigint").alias("size"))
    return per.agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("distinct_bytes"))


def reassembled(files: DataFrame, stored: DataFrame, separator: str = "") -> DataFrame:
    """path, content, missing: chunks joined back in order, and how many are not stored."""
    rows = files.select("path", F.posexplode("chunks").alias("pos", "chunk_id")).join(stored.select("chunk_id", "data"), "chunk_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "data")))
    return rows.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["data"]), separator).alias("content"), F.count_if(F.col("data").isNull()).alias("missing"))


def remainders(polynomial: int, window: int) -> list:
    """Per place from the end of a window, what each byte there adds to the remainder by `polynomial` over GF(2)."""
    import numpy as np

    degree = polynomial.bit_length() - 1
    rest, out = np.arange(256, dtype=np.uint64), []
    for _ in range(window):
        out.append(rest)
        for _ in range(8):  # times x
            rest = rest << np.uint64(1)
            rest = np.where(rest >> np.uint64(degree) & np.uint64(1) == 1, rest ^ np.uint64(polynomial), rest)
    return out


class Roller:
    """Content-defined cuts by a Rabin fingerprint: a cut where the remainder of the last `window` bytes has `bits` zero bits,
    between `least` and `most` bytes from the one before. What is held of a file is `most` bytes and one block."""

    STEP, BLOCK = 1 << 18, 1 << 20

    def __init__(self, least: int = LEAST, most: int = MOST, bits: int = BITS, polynomial: int = POLYNOMIAL, window: int = WINDOW):
        if not window <= least <= most:
            raise ValueError("bounds must be at least the window, and in order")
        self.least, self.most, self.bits, self.polynomial, self.window = least, most, bits, polynomial, window
        self.table = None

    def _cut(self, held: bytes, n: int) -> int:
        """Where the first chunk of the n bytes held ends."""
        import numpy as np

        n = min(n, self.most)
        if n <= self.least:
            return n
        self.table = self.table or remainders(self.polynomial, self.window)
        data, w = np.frombuffer(held, np.uint8, n), self.window
        for first in range(self.least, n, self.STEP):
            ends = min(self.STEP, n - first)  # cuts after first to first + ends - 1 bytes
            rest = np.zeros(ends, np.uint64)
            for j, t in enumerate(self.table):
                rest ^= t[data[first - 1 - j : first - 1 - j + ends]]
            hit = np.flatnonzero(rest & np.uint64((1 << self.bits) - 1) == 0)
            if len(hit):
                return first + int(hit[0])
        return n

    def pieces(self, read: Callable[[int], bytes]) -> Iterator[bytes]:
        """The chunks of what read(n) gives until it gives nothing; an empty file is one empty chunk."""
        held, ended, first = bytearray(), False, True
        while first or held or not ended:
            while not ended and len(held) < self.most:
                block = read(self.BLOCK)
                ended = not block
                held += block
            if held or first:
                end = self._cut(bytes(held), len(held))
                yield bytes(held[:end])
                del held[:end]
                first = False

    def cuts(self, data: bytes) -> Iterator[int]:
        from io import BytesIO

        end = 0
        for piece in self.pieces(BytesIO(data).read):
            end += len(piece)
            yield end


def content_defined(files: DataFrame, least: int = LEAST, most: int = MOST, bits: int = BITS, content: str = "content", polynomial: int = POLYNOMIAL) -> DataFrame:
    """path, pos, start, size, chunk_id of byte contents. A file up to `least` is one chunk, also when empty; null counts as empty."""
    roller = Roller(least, most, bits, polynomial)

    def run(batches):
        import hashlib
        from io import BytesIO

        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("path", "pos", "start", "size", "chunk_id")}
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                start = 0
                for pos, piece in enumerate(roller.pieces(BytesIO(data.as_py() or b"").read)):
                    for k, v in zip(out, (path, pos, start, len(piece), hashlib.sha1(piece).hexdigest()), strict=True):
                        out[k].append(v)
                    start += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["pos"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["chunk_id"], pa.string())], list(out))

    return files.select("path", F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, pos int, start bigint, size bigint, chunk_id string")
