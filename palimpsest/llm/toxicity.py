"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding maps homoglyphs (Cyrillic, Greek and full-width look-alikes), the digits and marks that stand for letters (0, 1, 3, 4, 5,
7, @ and $, wherever they are) and case to plain lower-case letters, and all other marks to spaces. The lexicon holds words and word beginnings ("stems") with
their log-odds weights, learned from labelled rows; exception phrases are two-word phrases around a lexicon word that
labelled clean texts carry and toxic ones don't, and they cancel the match they cover. A text's score is a logistic
function of its summed weight and of that sum per word (the length-normalised part).

Scale: fitting reads at most `most` labelled rows of at most `most_bytes` each to the driver, 94 MiB in all; the lexicon has at
most `most_entries` entries, which bounds the automaton that is broadcast; scoring is one narrow pass over whole texts, and
holds a few copies of a text and a number for each match.

Defined results: null and empty text score as texts without matches; without labelled rows of both kinds every score is
the share of toxic labels (0 if none); an id labelled both ways counts as toxic; repeated rows score alike; an empty table
gives an empty one; a column named score gives way to the result, and other columns are never inputs.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import with_columns
from .sample import by_hash, fold_of, texts

# Look-alikes and substitutions.
CYRILLIC = dict(zip("асеіјорѕухкмнвтѵԁԛԝһ", "aceijopsyxkmhbtvdqwh", strict=True))
GREEK = dict(zip("αβεικνορτυχ", "abeiknoptux", strict=True))
SUBSTITUTES = dict(zip("013457@$", "oieastas", strict=True))
FOLD = (
    {ord(a): b for a, b in {**CYRILLIC, **GREEK}.items()}
    | {0xFF21 + k: chr(97 + k) for k in range(26)}
    | {0xFF41 + k: chr(97 + k) for k in range(26)}
    | {k: " " for k in range(128) if not chr(k).isalnum()}
    | {ord(a): b for a, b in SUBSTITUTES.items()}
)
GAP = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Words of the folded text, each between single spaces."""
    return f" {GAP.sub(' ', text.lower().translate(FOLD)).strip()} "


class Lexicon:
    """Entries (pattern -> weight), exceptions, and the logistic's three coefficients."""

    def __init__(self, entries: dict[str, float], exceptions: set[str], coefficients: tuple[float, float, float]):
        self.entries, self.exceptions, self.coefficients = entries, exceptions, coefficients

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for pattern, weight in self.entries.items():
            a.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        a.make_automaton()
        return a

    def matches(self, text: str, automaton) -> dict[int, float]:
        """Greatest weight by word start, of folded text, but for words under an exception phrase."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(text):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        if not spared or not found:
            return found
        spared.sort()
        begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        # Of the phrases that begin at a match or before it, the one that ends last tells.
        under = lambda s: (k := bisect_right(begins, s)) > 0 and reach[k - 1] > s
        return {s: w for s, w in found.items() if not under(s)}

    def inputs(self, text: str, automaton) -> tuple[float, float]:
        """Summed weight on a log scale, and per word, of folded text."""
        total = sum(self.matches(text, automaton).values()) if automaton is not None else 0.0
        return math.log1p(total), 10 * total / (10 + text.count(" ") - 1)

    def score(self, text: str, automaton) -> float:
        a, b = self.inputs(folded(text), automaton)
        c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * a + c[2] * b))))


def stems(word: str) -> list[str]:
    """Patterns that a word may count under: itself whole, and its beginnings of 3 to 8 letters."""
    return [f" {word} ", *(f" {word[:k]}" for k in range(3, min(9, len(word) + 1)))]


def distinct(docs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without copies and most near copies, which would pass for evidence: a text goes if one of four least hashes of its
    word triples was seen before with the same label."""
    seen, out = set(), []
    turns = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)
    for text, y in docs:
        w = text.encode().split()
        grams = np.array([zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))], np.uint64)
        least = ((grams[:, None] * turns) & np.uint64(0xFFFFFFFF)).min(axis=0)
        keys = [(k, int(x), y) for k, x in enumerate(least)]
        if not seen.intersection(keys):
            out.append((text, y))
        seen.update(keys)
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def learn(rows: list[tuple[str, int]], most_entries: int = 5000, least: int = 4, purity: float = 4.0) -> Lexicon:
    """A lexicon from (text, 0 or 1) rows: patterns in `least` toxic texts (and 0.8 % of them) or more, with odds of `purity` to one or better for toxic."""
    docs = distinct([(folded(t or ""), int(y)) for t, y in rows])
    n = [sum(y == k for _, y in docs) for k in (0, 1)]
    if not all(n):
        p = min(max(n[1] / max(1, sum(n)), 1e-9), 1 - 1e-9)
        return Lexicon({}, set(), (math.log(p / (1 - p)), 0.0, 0.0))
    least = max(least, math.ceil(n[1] * 0.008))
    # Only patterns of words in toxic texts can enter; the rest of the clean vocabulary is not spelled out.
    hopeful = Counter()
    for t, y in docs:
        if y:
            hopeful.update({p for w in set(t.split()) for p in stems(w)})
    wanted = {p for p, k in hopeful.items() if k >= least}
    clean = Counter()
    for t, y in docs:
        if not y:
            clean.update({p for w in set(t.split()) for p in stems(w)} & wanted)
    weight = {}
    for p in wanted:
        toxic, other = hopeful[p], clean[p]
        # Rates among toxic and clean texts, shrunk by half a text.
        odds = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((other + 0.5) / (n[0] + 1))
        if (toxic + 0.5) / (other + 0.5) * n[0] / n[1] >= 20 and toxic >= purity * other:
            weight[p] = odds
    # Of a stem and its longer form, the longer stands for both if nearly all texts with the stem have it; otherwise the
    # stem does, if it is as good.
    common = {p for p in weight for q in (p[:-1],) if q in weight and hopeful[p] >= 0.95 * hopeful[q]}
    longer = {p: w for p, w in weight.items() if not any(q[:-1] == p for q in common)}
    kept = {p: w for p, w in longer.items() if not any(longer.get(p[:k], -1.0) >= w - 0.25 for k in range(4, len(p)))}
    entries = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:most_entries])
    lexicon = Lexicon(entries, set(), (0.0, 0.0, 0.0))
    automaton = lexicon.automaton() if entries else None
    if automaton is not None:
        phrases = [Counter(), Counter()]
        for t, y in docs:
            seen = set()
            for s in lexicon.matches(t, automaton):
                end = t.index(" ", s + 1)
                before, after = t.rfind(" ", 0, s), t.find(" ", end + 1)
                if before >= 0:
                    seen.add(t[before : end + 1])
                if after >= 0:
                    seen.add(t[s : after + 1])
            phrases[y].update(seen)
        lexicon.exceptions = {p for p, k in phrases[0].items() if k >= 3 and not phrases[1][p]}
        automaton = lexicon.automaton()
    x = np.array([lexicon.inputs(t, automaton) for t, _ in docs])
    y = np.array([y for _, y in docs], float)
    w = logistic(x, y)
    if min(w[1], w[2]) < 0:  # more or denser matches must never score lower: the input that hurts goes
        x[:, 0 if w[1] < w[2] else 1] = 0
        w = np.maximum(logistic(x, y), [-np.inf, 0, 0])
    lexicon.coefficients = tuple(w.tolist())
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0, most: int = 6000, most_bytes: int = 1 << 14) -> Lexicon:
    """Learn from labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & (fold_of(F.col(id), folds) != held_out))
    sample = by_hash(known.groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("label")), most)
    return learn(texts(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), sample, most, most_bytes))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", needed: list[str] | None = None) -> DataFrame:
    """`docs` with score."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        own = shared.value
        automaton = own.automaton() if own.entries else None

        def block(batch, data, offsets):
            raw = data.tobytes()
            return (pa.array([own.score(raw[a:b].decode(), automaton) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.float64()),)

        return block

    return with_columns(docs, text, [T.StructField("score", T.DoubleType())], make, needed)


def op8_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    done = score(docs, lexicon, needed=["doc_id"])
    return done.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
