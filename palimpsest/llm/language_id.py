"""Language identification by a byte convolutional network, written and trained in numpy.

A text is cut into windows of `WINDOW` bytes (A-Z folded; the last one padded), each embedded byte by byte, convolved with
filters of several widths, rectified, max-pooled over the window, and put through a linear layer and softmax. A text's
prediction is the mean of its windows' log probabilities, weighted by the bytes they hold. Every byte of every text is read.

Scale: training uses `windows_a_text` windows, spread over the text, of each of at most `most` labelled rows of at most
`most_bytes`, on the driver, 94 MiB in all; the network has some three thousand parameters and is broadcast; prediction is one
narrow pass that holds `batch` windows at a time, and some 60 bytes for each window of a text.

Defined results: `und` with score 0 where the text is null, empty or without a letter, or where no labels could be
learned; ties go to the language that sorts first; of several labels of one id the first in order counts; repeated rows are
predicted alike; an empty table gives an empty one; columns named lang_pred or score give way to the result, and others are
never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import with_columns
from .sample import by_hash, fold_of, texts

WINDOW, DEPTH, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4, 5)
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def places(offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, bytes held) of the windows of texts."""
    size = np.diff(offsets)
    n = -(-size // window)
    rows = np.repeat(np.arange(len(size)), n)
    start = offsets[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)) * window
    return rows, start, np.minimum(window, offsets[rows + 1] - start)


def windows_at(data: np.ndarray, start: np.ndarray, held: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The folded bytes of windows, padded with zeros."""
    out = np.zeros((len(start), window), np.uint8)
    inside = np.arange(window) < held[:, None]
    out[inside] = _FOLD[data[(start[:, None] + np.arange(window))[inside]]]
    return out


def cut(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, bytes in each) of texts."""
    rows, start, held = places(offsets, window)
    return windows_at(data, start, held, window), rows, held


def one_thread() -> None:
    """Tell numpy's bundled BLAS to use one thread: a task has one core, and the products here are small."""
    import ctypes
    from pathlib import Path

    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


class Network:
    """Embedding, filters by width, and the output layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": r.normal(0, 0.5, (256, DEPTH)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * DEPTH)) ** 0.5, (w * DEPTH, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """Log probabilities of windows; with `keep`, also what the backward pass needs."""
        n, length = x.shape
        e = self.p["e"][x].reshape(n, length * DEPTH)
        pooled, tops = [], []
        for w in WIDTHS:
            steps = length - w + 1
            view = np.lib.stride_tricks.as_strided(e, (n, steps, w * DEPTH), (e.strides[0], DEPTH * e.strides[1], e.strides[1]))
            a = np.ascontiguousarray(view).reshape(n * steps, w * DEPTH) @ self.p[f"w{w}"]
            a = a.reshape(n, steps, FILTERS)
            if keep:
                tops.append((a.argmax(axis=1), view))
            pooled.append(a.max(axis=1) + self.p[f"b{w}"])
        raw = np.concatenate(pooled, axis=1)
        h = np.maximum(raw, 0)
        z = h @ self.p["o"] + self.p["c"]
        z = z - z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return (log_p, raw, h, tops) if keep else log_p

    def tables(self) -> list[np.ndarray]:
        """Per offset, what each byte there adds to every filter that reaches so far: the embedding and the filters in one."""
        return [np.concatenate([self.p["e"] @ self.p[f"w{w}"][j * DEPTH : (j + 1) * DEPTH] for w in WIDTHS if w > j], axis=1).astype(np.float32) for j in range(max(WIDTHS))]

    def predict(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The log probabilities of `forward`, by table look-ups instead of products."""
        n, length = x.shape
        total = np.zeros((n, length, FILTERS * len(WIDTHS)), np.float32)
        for j, t in enumerate(tables):
            total[:, : length - j, -t.shape[1] :] += t.take(x[:, j:], axis=0)
        pooled = [total[:, : length - w + 1, k * FILTERS : (k + 1) * FILTERS].max(axis=1) + self.p[f"b{w}"] for k, w in enumerate(WIDTHS)]
        # Not a matrix product: its rounding would hang on the other windows of the batch.
        z = (np.maximum(np.concatenate(pooled, axis=1), 0)[:, :, None] * self.p["o"]).sum(axis=1) + self.p["c"]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        log_p, raw, h, tops = self.forward(x, True)
        n = len(x)
        d = np.exp(log_p)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        dh = (d @ self.p["o"].T) * (raw > 0)
        for i, w in enumerate(WIDTHS):
            at, view = tops[i]
            dw = dh[:, i * FILTERS : (i + 1) * FILTERS]
            seen = view[np.arange(n)[:, None], at]  # n, filters, w * depth: what each filter's maximum saw
            g[f"w{w}"] = np.einsum("nfk,nf->kf", seen, dw)
            g[f"b{w}"] = dw.sum(axis=0)
            back = (dw[:, :, None] * self.p[f"w{w}"].T[None]).reshape(n, FILTERS, w, DEPTH)
            where = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(g["e"], where, back)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on batches drawn evenly over the languages."""
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.array([r.choice(by[k]) for k in r.integers(0, len(by), batch)])
            g = self.gradients(x[pick], y[pick])
            lr = rate * (1 - t / (steps + 1)) + 1e-4
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def learn(rows: list[tuple[str, str]], steps: int = 500, windows_a_text: int = 4) -> Network | None:
    """A network from (text, language) rows; None without rows."""
    rows = [(t, y) for t, y in rows if t and any(c.isalpha() for c in t)]
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    xs, ys = [], []
    for t, y in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        x, _, held = cut(data, np.array([0, len(data)]))
        spread = np.unique(np.linspace(0, len(x) - 1, windows_a_text).astype(int))
        xs.append(x[spread])
        ys += [languages.index(y)] * len(spread)
        # Short texts are windows that are mostly padding: show some such.
        short = x[:1].copy()
        short[0, 24 + 40 * (len(xs) % 4) :] = 0
        xs.append(short)
        ys.append(languages.index(y))
    network = Network(languages)
    one_thread()
    if len(languages) > 1:
        network.train(np.concatenate(xs), np.array(ys), steps)
    return network


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held_out: int = 1, most: int = 3000, most_bytes: int = 1 << 15, steps: int = 500) -> Network | None:
    """Learn from rows with a language outside the held-out fold."""
    known = docs.where(F.col(lang).isNotNull() & F.col(id).isNotNull() & (fold_of(F.col(id), folds) != held_out))
    sample = by_hash(known.groupBy(F.col(id).alias("id")).agg(F.min(lang).alias("label")), most)
    return learn(texts(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), sample, most, most_bytes), steps)


def predict(docs: DataFrame, network: Network | None, text: str = "text", needed: list[str] | None = None, batch: int = 64) -> DataFrame:
    """`docs` with lang_pred and score, the probability that the mean over windows gives the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True

    def make():
        net = shared.value
        one_thread()
        tables = net.tables() if net else []

        def block(rows, data, offsets):
            n = rows.num_rows
            if net is None:
                return [UNKNOWN] * n, np.zeros(n)
            row, start, held = places(offsets)
            every = [net.predict(windows_at(data, start[a : a + batch], held[a : a + batch]), tables) for a in range(0, len(row), batch)]
            log_p = np.concatenate([np.zeros((0, len(net.languages))), *every])
            # Summed in the order of a text's windows alone, so that equal texts score alike wherever they lie.
            total = np.stack([np.bincount(row, log_p[:, k] * held, n) for k in range(log_p.shape[1])], axis=1)
            mean = total / np.maximum(np.diff(offsets), 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            named = np.array([letter[data[a:b]].any() or any(map(str.isalpha, data[a:b].tobytes().decode())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], bool)
            return [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, named, strict=True)], np.where(named, p[np.arange(n), best], 0.0)

        return block

    return with_columns(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, needed)


def op9_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    done = predict(docs.select("doc_id", "text"), fit(docs), needed=["doc_id"])
    return done.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
