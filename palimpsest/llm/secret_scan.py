"""Secret scan: Aho-Corasick keywords first, anchored regular expressions only at their hits, then checksums or structure.

Base kinds: `assign` (a keyword, a separator and a value of 12 characters or more), `access` (a key id of 18 or more) and
`hex` (16 or more hex digits; runs of that length are found with numpy, as no keyword leads to them). Within a kind,
matches are leftmost and don't overlap, and one whose value is too short still uses up its text. Further kinds must pass
a check that is embedded in them: `forge` and `registry` tokens carry the CRC-32 of their body in base 62, a `jwt` has a
header that decodes to JSON with an algorithm, a `pem` block has both its marks and base64 between them. Of the places in one
run of token characters where a `jwt` may begin, the first decides.

Scale: one narrow pass; the automaton is a few dozen fixed keywords. Work is in proportion to a text's length, whatever it
holds: patterns don't go back over what they have read, and no run is read from more than one of its places. Positions are
code points.

Defined results: null text is empty; repeated rows are scanned row by row, and equal spans of two kinds are both told; an
empty table gives an empty one; a column named secret_spans gives way to the result, and other columns don't matter.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import with_columns

# Keywords, patterns and kinds.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "forge", "registry", "jwt", "pem")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
FORGE_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
OTHER_MARKS = {"akia": "access", "npm_": "registry", "eyj": "jwt", "-----begin ": "pem"}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "forge": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "registry": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]*+"),
    "pem": re.compile(r"-----BEGIN ((?:[A-Z]++ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----"),
}
#: What a failed match has read, and no other match of its kind need read again.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]*+")}
HEX = re.compile(r"[0-9a-f]{16,}")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS62[r] + out
    return out.rjust(width, "0")


def _json(part: str) -> dict:
    try:
        value = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind in ("forge", "registry"):
        return base62(zlib.crc32(m[1].encode()), 6) == m[2]
    if kind == "jwt":
        return "alg" in _json(m[1])
    return len("".join(m[2].split())) >= 64


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, kind in [*((w, "assign") for w in ASSIGN_WORDS), *((w, "forge") for w in FORGE_MARKS), *OTHER_MARKS.items()]:
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str, with_hex: bool = True) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind."""
        low = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z alone, so positions stay
        hits = sorted((end - length + 1, kind) for end, (kind, length) in self.automaton.iter(low))
        free, out = dict.fromkeys(KINDS, 0), []
        for start, kind in hits:
            if start < free[kind]:
                continue
            m = PATTERNS[kind].match(text, start)
            if m and (ok := passes(kind, m)):
                out.append((kind, start, m.end()))
            if m and (ok or kind in BASE_KINDS):
                free[kind] = m.end()
            elif kind in RUNS and (m or text.startswith("eyJ", start)):
                free[kind] = RUNS[kind].match(text, start).end()
        if with_hex:
            out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def rows_with_hex_runs(data: np.ndarray, offsets: np.ndarray, length: int = 16) -> np.ndarray:
    """Whether a row may have `length` hex digits in a row."""
    digit = np.zeros(256, bool)
    digit[[*range(48, 58), *range(97, 103)]] = True
    inside = np.concatenate([[False], digit[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = change[::2], change[1::2]
    long = end - begin >= length
    out = np.zeros(len(offsets) - 1, bool)
    first = np.searchsorted(offsets, begin[long], "right") - 1
    last = np.searchsorted(offsets, end[long] - 1, "right") - 1
    for a, b in zip(first, last, strict=True):
        out[a : b + 1] = True
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan(docs: DataFrame, text: str = "text", needed: list[str] | None = None) -> DataFrame:
    """`docs` with secret_spans, in order."""

    def make():
        scanner = Scanner()

        def block(batch, data, offsets):
            hexed, raw, out = rows_with_hex_runs(data, offsets), data.tobytes(), []
            for a, b, x in zip(offsets[:-1].tolist(), offsets[1:].tolist(), hexed.tolist(), strict=True):
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(raw[a:b].decode(), x)])
            return (pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),)

        return block

    return with_columns(docs, text, [T.StructField("secret_spans", T.ArrayType(SPAN))], make, needed)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of `text` (overlapping ones as one) replaced by `mark`."""
    marked = scan(docs.select(F.struct("*").alias("__row"), F.col(text).alias("text")))

    def make():
        def block(batch, data, offsets):
            out = []
            for value, spans in zip(batch.column("text").to_pylist(), batch.column("secret_spans").to_pylist(), strict=True):
                at, parts = 0, []
                for s in spans:
                    if s["start"] >= at:
                        parts += [value[at : s["start"]], mark]
                    at = max(at, s["end"])
                out.append("".join(parts) + value[at:] if spans else value)
            return (pa.array(out, pa.string()),)

        return block

    done = with_columns(marked, "text", [T.StructField("__clean", T.StringType())], make)
    return done.select(*(F.col("__clean").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def op4_secret_scan(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), needed=["doc_id"])
    shown = F.transform("secret_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter(shown, lambda s: F.split_part(s, F.lit(":"), F.lit(1)).isin(*BASE_KINDS))
    return found.select("doc_id", *(_count(k) for k in BASE_KINDS), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", shown).alias("spans"))


def _count(kind: str):
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
