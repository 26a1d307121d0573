import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lakeloom.llm import quality


def test_ranking_recovers_a_known_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, quality.N_FEATURES))
    w = np.zeros(quality.N_FEATURES)
    w[:3] = (3, -2, 1)
    y = x @ w + rng.normal(scale=0.3, size=600) > -1
    model = quality.BradleyTerry(x, y)
    fresh = rng.normal(size=(400, quality.N_FEATURES))
    s, truth = model.score(fresh), fresh @ w > -1
    assert ((s >= 0.5) == truth).mean() > 0.9
    assert s[truth].mean() > s[~truth].mean() and ((0 <= s) & (s <= 1)).all()


def test_one_label_or_none():
    x = np.random.default_rng(1).normal(size=(10, quality.N_FEATURES))
    assert (quality.BradleyTerry(x, np.ones(10, bool)).score(x) >= 0.5).all()
    assert (quality.BradleyTerry(x, np.zeros(10, bool)).score(x) < 0.5).all()
    assert (quality.BradleyTerry(x[:0], np.zeros(0, bool)).score(x) >= 0.5).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.col("doc_id") % 3 == 1
    model = quality.learn(docs, labels.where(~held))
    out = quality.score(docs, model).join(labels.where(held), "doc_id")
    assert out.where("predicted = quality").count() >= 0.95 * out.count()


def test_odd_rows(spark):
    rows = [(k, "word and more words here, plainly said." * 3, "c") if k % 2 else (k, "&&& $$$ ###" * 9, "c") for k in range(40)]
    rows += [(100, None, "c"), (101, "", "c"), (None, "plain words", "c"), (3, "again " * 9, "c"), (102, "w " * 60_000, "c"), (103, "\n\n \t", "c"), (104, "é", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 1), (2, None), (None, 1), (999, 0), (5, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels, most=30)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 40 and not r.text.startswith("again"))
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels.limit(0))).count() == 0


def plain_features(text):
    """Each number by itself, from the text's words, lines and characters."""
    if not text:
        return [0.0] * quality.N_FEATURES
    raw, words = text.encode(), text.encode().split()
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    lines, n = [x for x in raw.split(b"\n") if x.strip()], max(1, len(words))
    two, three = list(zip(low, low[1:], strict=False)), list(zip(low, low[1:], low[2:], strict=False))
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    upper, letters = sum(65 <= b <= 90 for b in raw), sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
    top = lambda xs: max(Counter(xs).values(), default=0)
    out = [math.log1p(len(words)), math.log1p(len(lines)), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)), math.log1p(max(sizes)), len(set(low)) / n, len(set(low)) / math.sqrt(n)]
    out += [top(low) / n, len(set(two)) / max(1, n - 1), top(two) / n, len(set(three)) / max(1, n - 2), sum(a == b for a, b in two) / n, upper / max(1, letters)]
    out += [sum(48 <= b <= 57 for b in raw) / len(raw), letters / len(raw), sum(b in b" \t\n\x0b\x0c\r" for b in raw) / len(raw), sum(b >= 128 for b in raw) / len(raw)]
    out += [len(set(lines)) / max(1, len(lines)), sum(len(x) for x in set(lines)) / max(1, sum(len(x) for x in lines)), math.log1p(len(words) / max(1, len(lines)))]
    out += [sum(w[-1:] in quality._SIGNS for w in words) / n, sum(not w.isalnum() and all(b < 128 for b in w) for w in words) / n]
    return out + [math.sqrt(raw.count(bytes([s])) / len(raw)) for s in quality._SIGNS]


def test_features_match_plain_counts():
    rng = random.Random(2)
    texts = ["", " \n ", "A", "a a A b.\n\na a A b.\nx!", "Été 12 (ça) ::", *(" ".join(rng.choice(["a", "B", "c.", "é", "9", "|", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(40))]
    for t in texts:
        np.testing.assert_allclose(quality.features(t.encode()), plain_features(t), rtol=1e-9, atol=1e-12, err_msg=repr(t))
    assert not quality.features(None).any()


def test_fit_and_threshold_are_the_best_there_are():
    rng = np.random.default_rng(3)
    y = rng.random(60) < 0.5
    x = rng.normal(size=(60, quality.N_FEATURES)) + 0.7 * y[:, None] * (np.arange(quality.N_FEATURES) < 3)
    model = quality.BradleyTerry(x, y, pairs=500)
    z, draw = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6), np.random.default_rng(0)
    better, worse = draw.choice(np.flatnonzero(y), 500), draw.choice(np.flatnonzero(~y), 500)

    def loss(w):
        return sum(math.log1p(math.exp(-float(w @ (z[a] - z[b])))) for a, b in zip(better, worse, strict=True)) / 500 + 0.5e-3 * float(w @ w)

    best = loss(model.w)
    for _ in range(20):  # the loss is convex, so no step from its minimum lowers it
        assert loss(model.w + 1e-3 * rng.normal(size=len(model.w))) >= best
    scores = z @ model.w
    wrong = lambda cut: int(((scores >= cut) != y).sum())
    assert wrong(model.cut) == min(wrong(c) for c in [*scores, scores.max() + 1])
    np.testing.assert_array_equal(model.score(x) >= 0.5, scores >= model.cut)
