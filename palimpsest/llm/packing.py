"""Best-fit packing of token sequences by minimum bin slack.

Tokens. A document is its ids by the tokenizer, then one end id. For the word tokenizer, known by its normaliser and its
splitting rule, ids are made in batches: text is cut where the tokenizer itself would cut it (white space, letters, single
digits, other marks), each different piece is encoded once by the library's model and kept, and ids are gathered with numpy.
Anything that this cutting doesn't cover exactly (characters beyond Latin-1, apostrophes, the special tokens' marks) goes to
the library's own encoder, one white-space-delimited stretch at a time. A long text is taken in pieces that end at white
space. With any other tokenizer file, whole texts go to the library.

Packing. Only documents longer than a sequence are cut. Pieces matter to the packing by length alone, and there are at
most `capacity` lengths, so the plan is made on the driver from a histogram of at most `capacity` rows. Per bin, a bitset
subset-sum over the lengths left (longest fixed first) finds the fullest feasible combination; that combination is used
as often as the counts allow. The plan is a list of patterns, some thousand at most for any input. Pieces find their
places by their rank among those of their length: ranks come from counts per (length, chunk), never from a sort of a
whole length.

Defined results: null text is empty, and an empty document is the end id alone. Repeated rows are packed each by itself.
A null doc_id is kept. Pieces of one length are alike, so which of them lies where is open. An empty table gives an empty
one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import saved
from .kernel import U, row_blocks, span_hashes

CAPACITY = 4096
END = 1
MOST_KEPT, LONG = 1 << 20, 1 << 20
# The normaliser and the splitting rule that the batch encoder follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_CODES = np.random.default_rng(20250115).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: Classes of code points below 256: 0 white space, 1 letter, 2 digit, 3 mark, 4 left to the library.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|"]] = 3
_CLASS[ord("|")] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of many texts at once; the same as the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        state = lambda x: x and json.loads(x.__getstate__())
        marks = all("<" in t.content for t in self.library.get_added_tokens_decoder().values())  # a mark that always goes to the library
        self.batched = marks and type(self.model).__name__ == "BPE" and state(self.library.normalizer) == NORMALIZER and state(self.library.pre_tokenizer) == SPLITTER
        self.stand_in = {chr(b): c for b, c in _byte_letters().items()}
        self.clear()

    def clear(self) -> None:
        self.known: dict[int | str, int] = {}
        self.ids, self.begin, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def keep(self, ids: list[int]) -> int:
        n = len(self.known)
        if n >= len(self.begin):
            self.begin, self.count = np.concatenate([self.begin, self.begin]), np.concatenate([self.count, self.count])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.begin[n], self.count[n] = self.used, len(ids)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin): UTF-8 bytes and row offsets in."""
        if not self.batched:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rows = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *(len(r) for r in rows)])
        if len(offsets) != 2 or len(data) <= LONG:
            return self._encode(data, offsets)
        ids, at = [], 0
        while at < len(data):
            end = self._white(data, at + LONG)
            ids.append(self._encode(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(ids), np.array([0, sum(map(len, ids))])

    @staticmethod
    def _white(data: np.ndarray, at: int) -> int:
        """The first ASCII white space from `at` on, or the end."""
        for a in range(at, len(data), 1 << 16):
            part = data[a : a + (1 << 16)]
            hit = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            if len(hit):
                return a + int(hit[0])
        return len(data)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MOST_KEPT:
            self.clear()
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        # Row offsets in code points: bytes that begin one.
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        n = len(codes)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = np.where(codes < 256, _CLASS[np.minimum(codes, 255)], 4)
        edge = np.zeros(n, bool)
        edge[points[:-1][points[:-1] < n]] = True
        # Stretches between white space that hold anything odd go to the library whole.
        dark = kind != 0
        first = dark.copy()
        first[1:] &= ~dark[:-1] | edge[1:]
        stretch = np.cumsum(first) - 1
        odd = np.bincount(stretch[dark & (kind == 4)], minlength=int(stretch[-1]) + 1 if n else 0) > 0
        slow = dark & odd[np.maximum(stretch, 0)]
        kind = np.where(slow, 5, kind)
        begin = kind != 0
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2) | first[1:]
        starts = np.flatnonzero(begin)
        finish = kind != 0
        finish[:-1] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2) | first[1:]
        ends = np.flatnonzero(finish) + 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        low = np.where(codes < 256, _LOWER[np.minimum(codes, 255)], 0).astype(np.uint8)
        h = span_hashes(low, _CODES, starts, ends)
        is_slow = kind[starts] == 5
        h[is_slow] = np.arange(int(is_slow.sum())).astype(U)  # given below, one by one
        unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        number = np.empty(len(unique), np.int64)
        get = self.known.get
        text = low.tobytes().decode("latin-1")
        for i, (x, s, odd_one) in enumerate(zip(unique.tolist(), at.tolist(), is_slow[at].tolist(), strict=True)):
            a, b = starts[s], ends[s]
            if odd_one:
                data_key = codes[a:b].tobytes().decode("utf-32-le")
                k = get(data_key)
                if k is None:
                    k = self.known[data_key] = self.keep(self.library.encode(data_key, add_special_tokens=False).ids)
            else:
                k = get(x)
                if k is None:
                    piece = text[a:b]
                    piece = piece if piece.isascii() else "".join(self.stand_in[chr(c)] for c in piece.encode())
                    k = self.known[x] = self.keep([t.id for t in self.model.tokenize(piece)])
            number[i] = k
        number = number[inverse]
        count = self.count[number]
        where = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.begin[number] - where[:-1], count) + np.arange(where[-1])]
        return ids, where[np.searchsorted(starts, points)]


def tokenized(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of at most `capacity` ids: id, piece, start, length, ids_crc32, and its number among those of
    its length within a chunk of the input (chunk, nth)."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encoder, part = Encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for block, data, offsets in row_blocks(batches, "text", 1 << 20):
            ids, bounds = encoder.encode(data, offsets)
            out: list[tuple] = []
            for doc, a, b in zip(block.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), capacity)):
                    x = own[start : start + capacity]
                    out.append((doc, piece, start, len(x), zlib.crc32(x.tobytes()), part, int(seen[len(x)])))
                    seen[len(x)] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    more = "piece int, start long, length long, ids_crc32 long, chunk int, nth long"
    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string(more).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema).types
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id)


def fullest(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """The combination of (length, count) with the greatest sum up to `capacity` that holds the longest one, by bitset subset sums."""
    longest, n = lengths[0]
    room = capacity - longest
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in [(longest, n - 1), *lengths[1:]]:
        if length > room or not count:
            continue
        before, left, step = reach, min(count, room // length), 1
        while left > 0:  # copies by powers of two
            use = min(step, left)
            reach |= (reach << (use * length)) & mask
            left -= use
            step *= 2
        if reach != before:
            steps.append((length, count, before))
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    took = {longest: 1}
    for length, count, before in reversed(steps):
        while not before >> at & 1:
            at -= length
            took[length] = took.get(length, 0) + 1
    return sorted(took.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, combination) until no length is left."""
    left, out = dict(histogram), []
    while left:
        best = fullest(sorted(left.items(), reverse=True), capacity)
        times = min(left[length] // n for length, n in best)
        out.append((times, best))
        for length, n in best:
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return out


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (from `tokenized`, saved) with sequence_id and offset."""
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # Per length: from which rank on a pattern applies, its first sequence, copies in one sequence, offset of the first copy.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, combination in plan(histogram, capacity):
        offset = 0
        for length, n in combination:
            slots.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    table = {k: np.array(v, np.int64) for k, v in slots.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    before = counts.select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                own = order[a:b]
                size = int(length[own[0]])
                s = shared.value[size]
                k = np.searchsorted(s[:, 0], rank[own], "right") - 1
                r = rank[own] - s[k, 0]
                where[own], offset[own] = s[k, 1] + r // s[k, 2], s[k, 3] + r % s[k, 2] * size
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(where), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "chunk"]).withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0))).drop("before", "nth", "chunk")
    return ranked.mapInArrow(place, T.StructType(ranked.drop("rank").schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset. `path`: the tokenizer file, at the same place on all machines."""
    pieces = saved(tokenized(docs, path or default_tokenizer(), id, text, capacity, end), "pieces", narrow=True)
    return placed(pieces, capacity).select(id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_pack(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
