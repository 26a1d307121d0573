import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import lm_scoring, ppm

TEXTS = ["the cat sat", "the cat ran", "a cat", "", "été à la mer", "the the the", "日本 語"]


def naive_ppm(train, order, text):
    """The definition, symbol by symbol, with dictionaries and sets."""
    top = defaultdict(Counter)
    for t in train:
        own = bytes([ppm.PAD]) * order + t + bytes([ppm.END])
        for i in range(order, len(own)):
            top[own[i - order : i]][own[i]] += 1
    levels = {order: top}
    for k in range(order, 0, -1):
        levels[k - 1] = defaultdict(Counter)
        for context, symbols in levels[k].items():
            for s in symbols:
                levels[k - 1][context[1:]][s] += 1
    own, total = bytes([ppm.PAD]) * order + text + bytes([ppm.END]), 0.0
    for i in range(order, len(own)):
        gone = set()
        for k in range(order, -1, -1):
            left = {s: c for s, c in levels[k].get(own[i - k : i], {}).items() if s not in gone}
            if left:
                n = sum(left.values())
                if own[i] in left:
                    total += math.log10((left[own[i]] - 0.5) / n)
                    break
                total += math.log10(len(left) / 2 / n)
            gone |= set(levels[k].get(own[i - k : i], {}))
        else:
            total -= math.log10(max(1, 256 - len(gone)))
    return total


@pytest.mark.parametrize("order", [1, 2, 5])
def test_trie_scores_as_defined(order, monkeypatch):
    train = [t.encode() for t in TEXTS]
    model = ppm.Model(*ppm.count_grams(train, order), order)
    tested = [*train, b"zebra", b"the mat", "mère".encode(), b"xxxxxxxx"]
    want = [naive_ppm(train, order, t) for t in tested]
    np.testing.assert_allclose(model.score(tested), want, rtol=1e-5)
    monkeypatch.setattr(ppm, "CHUNK", 7)
    np.testing.assert_allclose(model.score(tested), want, rtol=1e-5)


def test_probabilities_add_up_to_one():
    train = [t.encode() for t in TEXTS]
    model = ppm.Model(*ppm.count_grams(train, 2), 2)
    for context in (b"th", b"zz", b"a ", b" c"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** model.log10(codes)).sum() == pytest.approx(1, abs=1e-5)


def test_nothing_learned():
    model = ppm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3)
    np.testing.assert_allclose(model.score([b"abc", b""]), [4 * math.log10(1 / 256), math.log10(1 / 256)])


def naive_base(train, texts):
    def lower(t):
        return "".join(c.lower() if c < "\x80" else c for c in t or "").encode().split()

    counts = Counter(w for t in train for w in [*lower(t), b""])
    n, v = sum(counts.values()), len(counts)
    return [(len(w) + 1, sum(counts[x] > 0 for x in [*w, b""]), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, b""])) for w in map(lower, texts)]


@pytest.mark.parametrize("frequent", [0, 4, 1000])
def test_base_score_of_odd_rows(spark, frequent):
    texts = [*TEXTS, None, "THE Cat", "unknown words here", "x\x1cy the", "w " * 30_000]
    rows = [(k, t, "clash", zlib.crc32(str(k).encode()) % 5 == 1) for k, t in enumerate(texts)] + [(2, "a cat", "clash", False), (None, "a dog", "clash", True), (None, None, "clash", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, held_out boolean").repartition(3)
    model = lm_scoring.learn(docs.where("not held_out"), max_frequent=frequent)
    out = lm_scoring.score(docs, model)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = naive_base([r[1] for r in rows if not r[3]], [r[1] for r in rows])
    key = lambda r: (str(r[0]), *(round(x, 6) for x in r[1:]))
    got = sorted(key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in out.collect())
    assert got == sorted(key((r[0], *w)) for r, w in zip(rows, want, strict=True))


def test_what_every_task_gets_is_bounded(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    full, small = lm_scoring.learn(docs), lm_scoring.learn(docs, max_grams=12)
    whole = ppm.count_grams([t.encode() for t in TEXTS], 5)
    np.testing.assert_array_equal(full.known[0], whole[0])
    np.testing.assert_allclose(full.known[1], ppm.Model(*whole, 5).log10(whole[0]), rtol=1e-5)
    assert 0 < len(small.known[0]) <= 12 and set(small.known[0]) <= set(full.known[0])
    assert len(lm_scoring.learn(docs, max_grams=0).known[0]) == 0


def test_known_codes_are_found_and_others_are_not():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 48, 3000, np.uint64))
    values = rng.normal(size=len(codes))
    known = ppm.Known(codes, values)
    asked = np.concatenate((codes, rng.integers(0, 1 << 48, 3000, np.uint64)))
    got, absent = known.find(asked)
    np.testing.assert_array_equal(got[: len(codes)], values)
    np.testing.assert_array_equal(absent, ~np.isin(asked, codes))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm_scoring.learn(none)
    assert (model.tokens, model.distinct) == (0, 0)
    assert lm_scoring.score(none, model).count() == 0
    one = lm_scoring.score(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), model).select("n_known", F.round("score", 6).alias("s")).first()
    assert one.n_known == 0 and one.s == round(3 * math.log10(1 / 256), 6)


@pytest.mark.parametrize("max_grams", [0, 12, 1 << 20])
def test_scores_come_from_all_counts_whatever_is_broadcast(spark, monkeypatch, max_grams):
    monkeypatch.setattr(ppm, "CHUNK", 50)
    monkeypatch.setattr(lm_scoring, "_LOOK_UP", 30)
    rows = [(k, t) for k, t in enumerate([*TEXTS, None, "zebra", "the mat", "xxxxxxxx", "mère à"])] + [(None, "the zebra"), (3, "the mat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm_scoring.learn(docs.where(f"doc_id < {len(TEXTS)} and text <> 'the mat'"), max_grams=max_grams)
    out = lm_scoring.score(docs.selectExpr("doc_id", "text", "text AS words", "doc_id AS part"), model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.part == r.doc_id and r.score == pytest.approx(naive_ppm([x.encode() for x in TEXTS], 5, (r.words or "").encode()), rel=1e-5), r
