import random
from collections import Counter

import numpy as np

from lakeloom.llm import langid


def naive_ngrams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    out = Counter()
    for w in words:
        for n in (1, 2, 3):
            padded = w if n == 1 else f" {w} "
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    # A space between two words is shared, so each pair (letter, space) counts once for each word.
    return out


def code(gram):
    return sum(ord(c) << 21 * (len(gram) - 1 - k) for k, c in enumerate(gram))


def test_ngrams_match_a_plain_count(monkeypatch):
    for text in ("", "123 !", "Ab", "été à la MER, l'été 日本語 x", "a" * 50, "Straße İx"):
        codes, counts = langid.ngrams(langid.spaced(text))
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in naive_ngrams(text).items()}
    monkeypatch.setattr(langid, "CHUNK", 5)
    text = "the cat sat on the mat, l'été"
    codes, counts = langid.ngrams(langid.spaced(text))
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in naive_ngrams(text).items()}


def test_out_of_place_distance():
    ranked = {"x": [code("a"), code("b"), code("c")], "y": [code("b"), code("a")]}
    profiles = langid.Profiles(ranked)
    grams = naive_ngrams("ab a")
    order = sorted(grams, key=lambda g: (-grams[g], code(g)))
    want = {lang: sum(abs(own.index(code(g)) - k) if code(g) in own else langid.PROFILE for k, g in enumerate(order)) for lang, own in ranked.items()}
    lang, score = profiles.predict("ab a")
    assert lang == min(sorted(want), key=want.get)
    assert abs(score - (1 - min(want.values()) / (langid.PROFILE * len(order)))) < 1e-12


def test_most_frequent_breaks_ties_by_code():
    assert langid.most_frequent(np.array([5, 3, 9, 1]), np.array([2, 2, 7, 2]), 3).tolist() == [9, 1, 3]


def test_learn_and_identify_odd_rows(spark):
    rng = random.Random(1)
    voices = {"aa": ["lo", "mi", "ra"], "bb": ["stü", "kx", "pfe"], "cc": ["да", "не", "ук"]}
    rows = [(k, lang, " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40)), "clash") for k, (lang, parts) in enumerate(list(voices.items()) * 12)]
    rows += [(100, None, "lomi rara", "c"), (101, "aa", None, "c"), (102, "bb", "", "c"), (103, "cc", "123 ...", "c"), (None, "aa", "lolo mimi " * 40_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score string").repartition(3)
    out = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert all(out[k].lang_pred == lang for k, lang, *_ in rows[:36])
    assert out[100].lang_pred == "aa" and out[None].lang_pred == "aa"
    assert [(out[k].lang_pred, out[k].score) for k in (101, 102, 103)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in out.values())


def test_profiles_and_predictions_match_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(langid, "_FLUSH", 20)
    most = langid.PROFILE
    rng = random.Random(2)
    voices = {"aa": "abc é", "bb": "bcd ü", "cc": "cda 1"}
    rows = [(k % 30, rng.choice([*voices, None]), None) for k in range(60)]
    rows = [(k, lang, "".join(rng.choice(voices.get(lang, "abcd")) for _ in range(rng.randint(0, 50))), "x") for k, lang, _ in rows]
    rows += rows[:7] + [(99, "aa", None, "x"), (None, "dd", "xy xy", "x"), (None, "ee", "xy xy", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, lang_pred string").repartition(3)
    counts = {}
    for _, lang, text, _ in rows:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(naive_ngrams(text))
    top = lambda c: sorted(c, key=lambda g: (-c[g], code(g)))[:most]
    ranked = {lang: top(c) for lang, c in counts.items() if c}

    def predict(text):
        own = top(naive_ngrams(text or ""))
        if not own:
            return "und", 0.0
        apart = {lang: sum(abs(p.index(g) - k) if g in p else most for k, g in enumerate(own)) for lang, p in ranked.items()}
        best = min(sorted(apart), key=apart.get)
        return best, round(1 - apart[best] / (most * len(own)), 9)

    out = langid.identify(docs, langid.learn(docs))
    assert sorted(out.columns) == ["doc_id", "lang", "lang_pred", "score", "text"]
    got = sorted(((r.doc_id, r.text, r.lang_pred, round(r.score, 9)) for r in out.collect()), key=str)
    assert got == sorted(((k, t, *predict(t)) for k, _, t, _ in rows), key=str)
    assert predict("xy xy")[0] == "dd"  # as near as "ee"


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    profiles = langid.learn(none)
    assert profiles.predict("abc") == ("und", 0.0)
    assert langid.identify(none, profiles).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    held = F.col("doc_id") % 4 == 2
    out = langid.identify(docs.where(held), langid.learn(docs.where(~held)))
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()
