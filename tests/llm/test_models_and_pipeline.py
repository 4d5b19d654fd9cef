"""Packing, toxicity, language and quality against brute force and held-out labels; the pipeline stage by stage."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.test_text_operators import brute_components, brute_contamination

from palimpsest.llm import language_id, packing, pipeline, quality, toxicity
from palimpsest.llm.kernel import text_bytes

WORDS = {"en": "the of and thing other with from".split(), "fr": "les été garçon où très être".split(), "de": "der über groß nicht straße und".split()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


ODD = [
    "", "It's they're <|endoftext|> x<|startoftext|>y", "ÀÉ straße ﬁ ½ 12 3 ³ a_b—c “q” 中文 é  z İx", "!!'s 'tis ''ll it''s", "a|b <a|b> <|", "\x00\x01 a", "\u0085x y z", "µm ªº n~ñ +=-", "ß ẞ Ω K ſ", "é ́x Å",
    "x" * 5000, "a " * 3000, "\t\n\r\x0b\x0c\x1c\x1d  a", "٣ ५ ⅷ 𝒜 😀😀",
]


def test_encoder_equals_the_library(library, texts):
    encoder = packing.Encoder(packing.default_tokenizer())
    r = random.Random(3)
    alphabet = "abcXYZ éÉß0123 .,'!|<>\n_-" + "çñ½“中́"
    every = [t or "" for t in texts] + ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)]
    for part in (every, every[::-1]):
        ids, at = encoder.encode(*text_bytes(pa.array(part)))
        for k, t in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_long_texts_are_encoded_in_pieces(library, monkeypatch):
    """A text beyond LONG is cut at white space; so is one that has none for long."""
    monkeypatch.setattr(packing, "LONG", 300)
    r = random.Random(8)
    encoder = packing.Encoder(packing.default_tokenizer())
    for alphabet in ("abc déf 12 ,. \n\t", "abcdef'<é", "x \u2003\x85y“z ", "a"):
        text = "".join(r.choice(alphabet) for _ in range(5000))
        ids, at = encoder.encode(*text_bytes(pa.array([text])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and at.tolist() == [0, len(ids)]


def test_other_tokenizers_go_to_the_library(texts):
    """Another file has other rules: ids are the library's for any text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = packing.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.batched and packing.Encoder(packing.default_tokenizer()).batched
    every = [t or "" for t in texts] + ODD
    ids, at = encoder.encode(*text_bytes(pa.array(every)))
    for k, t in enumerate(every):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
    assert encoder.encode(*text_bytes(pa.array([], pa.string())))[1].tolist() == [0]


def check_packing(rows, docs, library, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(docs)
    for d, pieces in by.items():
        ids = [*library.encode(docs[d] or "", add_special_tokens=False).ids, 1]
        pieces.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces]
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r.length for r in rows)


def test_packing(docs, texts, library, empty):
    for capacity in (64, 4096):
        n, total = check_packing(packing.pack(docs, capacity=capacity).collect(), {10 * k + 3: t for k, t in enumerate(texts)}, library, capacity)
        assert -(-total // capacity) <= n <= total / capacity * 1.02 + 1  # the heuristic needs not be optimal on few pieces
    assert packing.pack(empty).count() == 0
    twice = docs.select("doc_id", "text", F.lit(1).alias("piece")).where("doc_id = 3")
    assert packing.pack(twice.union(twice)).select("offset").distinct().count() == 2


def brute_fullest(lengths, capacity):
    best = {0}
    first = lengths[0][0]
    for length, count in [(first, lengths[0][1] - 1), *lengths[1:]]:
        best |= {s + k * length for s in best for k in range(1, count + 1) if first + s + k * length <= capacity}
    return first + max(best)


def test_fullest_combination_and_plan():
    r = random.Random(9)
    for _ in range(200):
        lengths = sorted({r.randrange(1, 60): r.randrange(1, 4) for _ in range(r.randrange(1, 7))}.items(), reverse=True)
        got = packing.fullest(lengths, 60)
        assert all(n <= dict(lengths)[length] for length, n in got) and got[0][0] == lengths[0][0]
        assert sum(length * n for length, n in got) == brute_fullest(lengths, 60)
    h = {r.randrange(1, 4097): r.randrange(1, 50) for _ in range(800)}
    used = collections.Counter()
    for times, combination in packing.plan(h):
        assert sum(length * n for length, n in combination) <= 4096
        used.update({length: n * times for length, n in combination})
    assert used == h


# Classifiers


def labelled(n=600, seed=2):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(list(WORDS))
        w = [r.choice(WORDS[lang]) + str(r.choice("abcdefgh")) * r.randrange(3) for _ in range(r.randrange(8, 80))]
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(("vilkor", "VILK0RA", "vilkоr", "grumph"))
        if not good:
            w = [x.upper() + "!!" for x in w]
        rows.append((k, " ".join(w), lang, f"s{k % 3}", 0, toxic, good))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    rows = labelled()
    odd = [(9001, None), (9002, ""), (9003, "12 !? 34"), (9004, "  "), (None, "the of")]
    docs = spark.createDataFrame([(d, t, x, s, n) for d, t, x, s, n, _, _ in rows] + [(d, t, None, None, None) for d, t in odd], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(d, good, toxic) for d, _, _, _, _, toxic, good in rows] + [(7777, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, rows = corpus
    lexicon = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("score", F.lit("x")), lexicon).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 60 and sum((got[r[0]] >= 0.5) == r[5] for r in held) / len(held) > 0.97
    assert got[9001] == got[9002] < 0.5
    assert len(got) == len(rows) + 5


def test_toxicity_folding_and_exceptions():
    assert toxicity.folded("V1lk0r, ВILKОR ｖｉｌｋｏｒ!") == " vilkor bilkor vilkor "
    r = random.Random(6)
    words = [f"{b}{a}{c}" for a in "kelm tab sulv drat wins".split() for b in "a ek il os urn".split() for c in "a ek il os urn".split()]
    filler = lambda: " ".join(r.choice(words) for _ in range(60))
    clean = [(f"{filler()} vilkor fish {filler()}", 0) for _ in range(6)] + [(filler() + filler(), 0) for _ in range(200)]
    toxic = [(f"{filler()} vilkor {filler()}", 1) for _ in range(40)]
    lexicon = toxicity.learn(clean + toxic)
    a = lexicon.automaton()
    assert lexicon.exceptions
    assert lexicon.score("one vilkor fish swims", a) < 0.5 < lexicon.score("that vilkor again", a)
    assert toxicity.learn([]).score("x", None) < 1e-6
    assert toxicity.learn([("x", 0)] * 3).score("x", None) < 1e-6


def naive_score(lexicon, text):
    """By looking for every entry at every word, and every exception at every place."""
    t = toxicity.folded(text)
    found = {}
    for p, w in lexicon.entries.items():
        for k in range(len(t)):
            if t.startswith(p, k):
                found[k] = max(w, found.get(k, 0.0))
    spared = [(k, k + len(p) - 1) for p in lexicon.exceptions for k in range(len(t)) if t.startswith(p, k)]
    total = sum(w for k, w in found.items() if not any(a <= k < b for a, b in spared))
    words = len(t.split())
    a, b, c = lexicon.coefficients
    return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * 10 * total / (10 + words), -30, 30)))


def test_toxicity_scores_against_plain_search(corpus):
    docs, labels, _ = corpus
    lexicon = toxicity.fit(docs, labels)
    assert lexicon.entries
    lexicon.exceptions = {" vilkor the ", " of vilkor ", " the of ", " grumph grumph "}
    r = random.Random(5)
    words = ["vilkor", "V1LKOR", "vіlkоr", "vilkora", "grumph", "grum", "the", "of", "other", "ｖｉｌｋｏｒ", "@nd", "“x”", "_", "ß"]
    automaton = lexicon.automaton()
    for n in (0, 1, 2, 5, 30):
        for _ in range(40):
            text = " ".join(r.choice(words) + r.choice(("", "", ".", "\n", "!!")) for _ in range(n))
            assert abs(lexicon.score(text, automaton) - naive_score(lexicon, text)) < 1e-9


def test_many_exceptions_take_time_in_proportion():
    import time

    lexicon = toxicity.Lexicon({" vilkor ": 3.0, " vil": 1.0}, {" vilkor fish ", " the vilkor "}, (0.0, 1.0, 1.0))
    text, automaton = toxicity.folded("the vilkor fish swims vilkor alone " * 100_000), lexicon.automaton()
    began = time.process_time()
    found = lexicon.matches(text, automaton)
    assert len(found) == 100_000 and time.process_time() - began < 10


def test_classifiers_of_odd_rows(corpus, spark):
    """Ties, repeated rows, labels of both kinds for one id, an empty table, and a text of some megabytes."""
    docs, labels, rows = corpus
    more = labels.union(spark.createDataFrame([(5, 1, 1), (6, 0, 0), (6, 1, 1)], labels.schema))
    twice = docs.union(docs.where("doc_id < 20")).withColumn("lang_pred", F.lit(1)).withColumn("a.b", F.lit(2))
    long = spark.createDataFrame([(8000, "vilkor the other " * 200_000)], "doc_id long, text string")
    lexicon = toxicity.fit(twice, more)
    by = collections.defaultdict(set)
    for x in toxicity.score(twice.select("doc_id", "text").union(long), lexicon).collect():
        by[x.doc_id, x.text].add(x.score)
    assert all(len(v) == 1 and 0 <= min(v) <= 1 for v in by.values())
    network = language_id.fit(twice.drop("lang_pred"), steps=60)
    by = collections.defaultdict(set)
    for x in language_id.predict(twice.select("doc_id", "text", "lang_pred", "`a.b`").union(long.select("*", F.lit(1), F.lit(2))), network).collect():
        by[x.doc_id, x.text].add((x.lang_pred, x.score))
    assert all(len(v) == 1 for v in by.values())
    assert language_id.predict(docs.where("false"), network).count() == toxicity.score(docs.where("false"), lexicon).count() == 0


def test_fitting_with_empty_tables(corpus, spark):
    docs, labels, _ = corpus
    none = labels.where("false")
    assert toxicity.score(docs, toxicity.fit(docs, none)).count() == docs.count()
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.where("lang IS NULL"))).collect()} == {"und"}
    assert quality.resample(docs, none).where("NOT selected").count() == 0
    assert quality.resample(docs.where("false"), labels).count() == 0


def test_language_on_held_out_rows(corpus):
    docs, _, rows = corpus
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs, steps=300)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]][0] == r[2] for r in held) / len(held) > 0.97
    assert all(got[d] == ("und", 0.0) for d in (9001, 9002, 9003, 9004)) and got[None][0] == "en"


def test_network_gradients():
    r = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(0, 6, (5, 30)).astype(np.uint8), r.integers(0, 3, 5)
    g = net.gradients(x, y)
    loss = lambda: -net.forward(x)[np.arange(5), y].mean()
    for name in ("e", "w2", "w5", "b3", "o", "c"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-6
        up = loss()
        net.p[name][at] = before - 1e-6
        down = loss()
        net.p[name][at] = before
        assert abs((up - down) / 2e-6 - g[name][at]) < 1e-5


def test_lookup_equals_convolution():
    net = language_id.Network(["a", "b"], seed=3)
    x = np.random.default_rng(4).integers(0, 256, (9, language_id.WINDOW)).astype(np.uint8)
    assert np.allclose(net.forward(x), net.predict(x, net.tables()), atol=1e-4)


def test_windows_read_every_byte():
    data, offsets = text_bytes(pa.array(["ab" * 300, "", "X", None, "y" * 256]))
    x, rows, held = language_id.cut(data, offsets)
    assert rows.tolist() == [0, 0, 0, 2, 4] and held.tolist() == [256, 256, 88, 1, 256]
    assert b"".join(w[:n].tobytes() for w, n in zip(x, held, strict=True)) == ("ab" * 300 + "x" + "y" * 256).encode()


def test_windows_of_a_long_text_in_bounded_memory():
    import tracemalloc

    n = 16 << 20
    data, offsets = np.full(n, 97, np.uint8), np.array([0, n])
    tracemalloc.start()
    rows, start, held = language_id.places(offsets)
    for a in range(0, len(rows), 4096):
        assert language_id.windows_at(data, start[a : a + 4096], held[a : a + 4096]).shape[1] == language_id.WINDOW
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 2 * n


def test_quality_on_labels(corpus):
    docs, labels, rows = corpus
    got = {r["__row"].doc_id: r.selected for r in quality.resample(docs, labels).collect()}
    assert sum(got[r[0]] == bool(r[6]) for r in rows) / len(rows) > 0.97
    kept = quality.keep_selected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


@pytest.fixture(scope="module")
def doubtful(spark):
    """Good documents have few loud words, bad ones many, and their shares overlap: labels leave many documents in doubt."""
    r = random.Random(12)
    rows = []
    for k in range(900):
        good = k % 2
        share = min(1, max(0, r.gauss(0.35 if good else 0.65, 0.12)))
        rows.append((k, " ".join("LOUD!!" if r.random() < share else r.choice(WORDS["en"]) for _ in range(60)), good))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(2).cache()
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")


def test_the_draw_takes_documents_in_proportion(doubtful):
    """Over many seeds each document is taken about as often as a brute-force Gumbel top-k on the same odds takes it."""
    docs, labels = doubtful
    runs = [{r["__row"].doc_id: r for r in quality.resample(docs, labels, k=450, seed=seed).collect()} for seed in range(12)]
    odds = np.array([runs[0][d].log_odds for d in range(900)])
    taken = np.mean([[run[d].selected for d in range(900)] for run in runs], axis=0)
    assert all(sum(x.selected for x in run.values()) == 450 for run in runs)
    r = np.random.default_rng(1)
    want = np.zeros(900)
    for _ in range(400):
        key = odds - np.log(-np.log(r.random(900)))
        want[np.argsort(-key)[:450]] += 1 / 400
    order = np.argsort(odds)
    for part in np.array_split(order, 9):
        assert abs(taken[part].mean() - want[part].mean()) < 0.06
    top = set(order[-450:].tolist())
    assert all(20 < len(top - {d for d in run if run[d].selected}) for run in runs)  # not the plain top k
    assert 0.02 < taken[order[100:400]].mean() < taken[order[500:800]].mean() < 0.98


def test_equal_seeds_draw_alike_and_a_cold_draw_is_the_top(doubtful):
    docs, labels = doubtful
    pick = lambda **o: {r["__row"].doc_id for r in quality.resample(docs, labels, k=300, **o).where("selected").collect()}
    assert pick() == pick()
    rows = quality.resample(docs, labels, k=300, temperature=1e-5).collect()
    least = sorted((r.log_odds for r in rows), reverse=True)[299]
    assert all(r.selected == (r.log_odds >= least) for r in rows if r.log_odds != least)


def test_quality_of_odd_rows(corpus, spark):
    docs, labels, _ = corpus
    odd = docs.withColumn("__row", F.lit(1)).withColumn("__id", F.lit(2)).withColumn("a.b", F.lit(3)).withColumn("key", F.lit(4)).withColumn("log_odds", F.lit("x"))
    odd = odd.union(odd.where("doc_id < 3")).union(odd.where("doc_id = 4").withColumn("text", F.lit("LOUD!! " * 200_000)))
    kept = quality.keep_selected(odd, labels)
    assert kept.columns == odd.columns
    rows = quality.resample(odd, labels).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["__row"].doc_id, r["__row"].text].add(r.selected)
    assert all(len(v) == 1 for v in by.values())  # repeated rows share their draw
    assert [(r.log_weight, r.n_words) for r in rows if r["__row"].doc_id in (9001, 9002)] == [(0.0, 0), (0.0, 0)]
    assert max(r.n_words for r in rows) == 200_000
    one_kind = labels.where("quality = 1")
    assert quality.resample(docs, one_kind).where("NOT selected").count() == 0


def test_kth_largest(spark):
    r = random.Random(1)
    keys = [r.choice((r.randrange(-(1 << 63), 1 << 63), r.randrange(5), -1)) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 77, 499, 500):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, 501) is None


def test_counts_and_weights_against_brute_force(spark, corpus):
    docs, _, rows = corpus
    part = docs.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 2).cast("int").alias("good"), F.coalesce(F.col("doc_id") % 3, F.lit(0)).cast("int").alias("part"))
    counted = quality._counted(part, 64, 128).collect()
    want, gathered, every = np.zeros((2, 192)), {}, docs.collect()
    for r in every:
        words = (r.text or "").split()
        _, b = quality.grams(*text_bytes(pa.array([r.text])), 64, 128)
        assert len(b) == 2 * max(0, 2 * len(words) - 1)
        want[0] += np.bincount(b, minlength=192)
        if r.doc_id is not None and r.doc_id % 2 == 1 and r.doc_id % 3 < 2:
            want[1] += np.bincount(b, minlength=192)
        if r.doc_id is not None and r.doc_id % 3 == 2:
            gathered[r.doc_id] = (r.doc_id % 2, sorted(b.tolist()))
    got = np.zeros((2, 192))
    for r in counted:
        if r.bucket >= 0:
            got[:, r.bucket] = r.n, r.n_good
    assert (got == want).all()
    assert {r.id: (r.good, sorted(np.frombuffer(r.grams, np.int32).tolist())) for r in counted if r.bucket < 0} == gathered
    odds = quality.Odds(np.concatenate([quality.log_ratio(got[:, :64]), quality.log_ratio(got[:, 64:])]), 64)
    text = next(r.text for r in every if r.doc_id == 7)
    _, b = quality.grams(*text_bytes(pa.array([text])), 64, 128)
    sums = odds.sums(np.zeros(len(b), np.int64), b, 1)
    for half, (lo, hi) in enumerate(((0, 64), (64, 192))):
        seen = got[0, lo:hi] > 0
        p = (got[1, lo:hi] + 1) / (got[1, lo:hi].sum() + seen.sum())
        q = (got[0, lo:hi] + 1) / (got[0, lo:hi].sum() + seen.sum())
        assert abs(sums[half, 0] - sum(float(np.log(p[x - lo] / q[x - lo])) for x in b if lo <= x < hi)) < 1e-9


# The pipeline


def test_stages(spark, corpus, tmp_path, library):
    docs, labels, rows = corpus
    r = random.Random(4)
    passage = " ".join(f"bench{r.randrange(10**6)}" for _ in range(20))
    clean = [" ".join(f"{r.choice(WORDS['en'])}{r.randrange(10**4)}" for _ in range(60)) for _ in range(4)]
    extra = [(5000, clean[0] + " " + passage, "en", "s0", 1), (5001, clean[1], "en", "s0", 1), (5002, clean[1] + " tail", "en", "s1", 1), (5003, clean[2], "en", "s1", 1)]
    extra += [(6000 + k, f"{clean[3]} {' '.join(str(r.random()) for _ in range(40))}\nboiler plate line\nrest {k}", "en", "s9", 1) for k in range(12)]
    spark.createDataFrame(extra, docs.schema).union(docs).write.parquet(str(tmp_path / "documents.parquet"))
    more = spark.createDataFrame([(d, 1, 0) for d, *_ in extra], labels.schema)
    labels.union(more).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    seen = []
    for name, stage in pipeline.STAGES:
        before = {x.doc_id: x for x in at.collect()}
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
            kept = {x.doc_id: x.text for x in after.collect()}
        if name == "quality":
            assert all(d in kept for d, *_ in extra)
            assert sum((x[0] in kept) == bool(x[6]) for x in rows) / len(rows) > 0.97
        elif name == "line_dedup":
            assert set(kept) == set(before) and all("boiler plate" not in (kept[6000 + k]) for k in range(12)) and kept[5003] == clean[2]
        elif name == "near_duplicates":
            want = brute_components([(d, x.text) for d, x in before.items() if d is not None], 80, 5)
            assert set(kept) - {None} == {d for d, (_, c) in want.items() if c == d}
            assert 5002 not in kept and 5001 in kept
        elif name == "decontamination":
            hits = brute_contamination([x.text for x in before.values()], [(1, passage)])
            assert set(kept) == {d for d, (n, h, _) in zip(before, hits, strict=True) if not (h and 20 * h >= n)} and 5000 not in kept
        else:
            check_packing(after.collect(), {d: x.text for d, x in before.items()}, library, 4096)
        at = after
        seen.append(name)
    digest = lambda df: hashlib.sha256(repr(sorted(map(repr, df.select("doc_id", "piece", "ids_crc32").collect()))).encode()).hexdigest()
    assert digest(pipeline.run(spark, str(tmp_path))) == digest(at)


def test_copies_do_not_make_their_lines_boilerplate(spark, corpus):
    """A third of the rows, over all sources, are copies of one document: one copy stays whole; a host's true boilerplate goes."""
    docs = corpus[0]
    text = "first of its lines\nsecond of its lines\n\nlast of its lines here"
    rows = [(k, f"menu\npage {k} has words {k * k} of its own", "en", f"s{k % 4}", 1) for k in range(80)]
    rows += [(1000 + k, text, "en", f"s{k % 4}", 1) for k in range(39)] + [(2000, text + "\n \n", "en", "s0", 1), (2001, None, "en", "s1", 1)]
    cut = pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, docs.schema).repartition(3), "")
    got = {r.doc_id: r.text for r in cut.collect()}
    assert len(got) == len(rows) and got[2001] is None
    assert all(got[1000 + k] == text for k in range(39)) and all(got[k] == f"page {k} has words {k * k} of its own" for k in range(80))
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, cut.where("doc_id >= 1000"), "").collect()}
    assert kept == {1000, 2001}


def test_near_copies_keep_their_lines(spark, corpus):
    """A third of a source's rows are near copies, alike in all lines but one: they stay whole, one of them is kept in the end, and
    true boilerplate still goes."""
    docs, r = corpus[0], random.Random(9)
    lines = [" ".join(f"w{r.randrange(10**6)}" for _ in range(12)) for _ in range(9)]
    rows = [(k, f"menu\npage {k} has words {k * k} of its own\nand {k + 7} more", "en", "s", 1) for k in range(80)]
    rows += [(1000 + k, "\n".join([*lines, f"and line {k}"]), "en", "s", 1) for k in range(40)]
    cut = pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, docs.schema).repartition(3), "")
    got = {x.doc_id: x.text for x in cut.collect()}
    assert all(got[d] == t for d, t, *_ in rows if d >= 1000) and not any(got[k].startswith("menu") for k in range(80))
    kept = {x.doc_id for x in pipeline.drop_near_duplicates(spark, cut, "").collect()}
    assert kept == {*range(80), 1000}


def test_near_duplicates_of_repeated_and_null_ids(spark, corpus):
    r = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(4, a), (4, a), (4, b + " tail"), (2, b), (7, c), (None, c), (None, c.upper()), (None, d), (None, d + " end"), (None, e), (9, ""), (9, ""), (10, ""), (None, None), (11, None), (12, "page")]
    docs = spark.createDataFrame([(k, t, "en", "s0", 1) for k, t in rows], corpus[0].schema).repartition(3)
    got = [(x.doc_id, x.text) for x in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    ds = [x for x in got if x in ((None, d), (None, d + " end"))]
    assert len(ds) == 1
    assert sorted((x for x in got if x not in ds), key=repr) == sorted([(4, a), (2, b), (7, c), (None, e), (9, ""), (10, ""), (None, None), (11, None), (12, "page")], key=repr)


def test_stages_of_odd_tables(spark, corpus, tmp_path):
    """Empty tables, extra columns whose names clash, repeated rows, null ids and texts, and one very long text, in every stage."""
    docs, labels, rows = corpus
    r = random.Random(3)
    passage = " ".join(f"bench{r.randrange(10**6)}" for _ in range(20))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["__row", "key", "c0", "row", "id", "component_id", "n_words", "kept_text", "a.b", "hit_spans", "selected", "__host", "piece"]
    clash = docs
    for k, c in enumerate(names):
        clash = clash.withColumn(c, F.lit(k))
    long = clash.where("doc_id = 4").withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(150_000)), lambda x: F.concat(F.lit("w"), x.cast("string")))))
    odd = clash.where("doc_id < 60 OR doc_id IS NULL OR doc_id > 9000").unionByName(clash.where("doc_id IN (1, 2, 2)")).unionByName(long)
    odd.write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    n = odd.count()
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        got = out.collect()
        assert all(tuple(x[c] for c in names) == tuple(range(len(names))) for x in got)
        if name == "quality":
            assert len({x.doc_id for x in got if x.doc_id in (1, 2)}) * 2 == sum(x.doc_id in (1, 2) for x in got)
        elif name == "near_duplicates":
            assert len(got) == len({tuple(x) for x in got}) == n - 2 and sum(x.text is None for x in got) == 1
        else:
            assert len(got) == n
    packed = pipeline.pack(spark, odd, str(tmp_path)).collect()
    assert sum(x.piece == 0 for x in packed) == n and max(x.piece for x in packed) > 50
    assert pipeline.pack(spark, odd.where("false"), str(tmp_path)).count() == 0
