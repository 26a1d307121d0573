import hashlib
import random
import re

import pytest

from lakeloom.llm import decontaminate


def naive(texts, items):
    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    out = []
    for text in texts:
        own, hit, ids = words(text), set(), set()
        for key, item in items:
            its = words(item)
            m = min(13, len(its))
            for s in range(len(its) - m + 1 if m else 0):
                for p in range(len(own) - m + 1):
                    if own[p : p + m] == its[s : s + m]:
                        hit.update(range(p, p + m))
                        ids |= {key}
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return out


@pytest.mark.parametrize(("block", "shift", "bits"), [(40, 18, 27), (40, 3, 7), (1 << 20, 18, 27)])
def test_matches_brute_force_by_broadcast_and_by_join(spark, monkeypatch, block, shift, bits):
    for name, value in (("BENCHMARK_BYTES", block), ("SHIFT_BITS", shift), ("FILTER_BITS", bits)):
        monkeypatch.setattr(decontaminate, name, value)
    rng = random.Random(block)
    some = lambda n, letters="abc": " ".join(rng.choice(letters) for _ in range(n))
    items = [(k, some(rng.choice([1, 2, 3, 13, 14, 20, 40]), "abcd")) for k in range(6)]
    items += [(10, "É Ü! 3"), (11, None), (12, ""), (None, "only here"), (13, items[0][1]), (13, "twice " * 15), (2, items[2][1])]
    texts = [None, "", "only here", "é ü! 3 É-Ü/3", some(60), "x " * 50_000 + items[3][1] + " y", "twice " * 40]
    texts += [some(rng.randint(1, 30)) + ", " + (rng.choice(items)[1] or "").upper() + " " + some(rng.randint(0, 300)) if rng.random() < 0.7 else some(25, "abcdefgh") for _ in range(25)]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(None, "only here", 5)], "doc_id long, text string, bench_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_benchmark(docs, bench)
    assert out.columns == ["doc_id", "text", "bench_words", "bench_spans", "bench_items"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found = decontaminate.verdict(out).collect()
    want = naive([*texts, "only here"], items)
    for r in found:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[-1 if r.doc_id is None else r.doc_id]
    assert len(found) == len(want)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_a_text_that_repeats_is_one(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", most)
    monkeypatch.setattr(decontaminate, "IDS", 40)
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "none of it"), (3, None)], "doc_id long, text string")
    same = spark.createDataFrame([(k, text) for k in range(100)] + [(5, text)], "item_id long, text string")
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: (sent.append(x), broadcast(x))[1])
    got = {r.doc_id: r.bench_items for r in decontaminate.find_benchmark(docs, same).collect()}
    assert got == {1: sorted(map(str, range(100))), 2: [], 3: []}
    if most:
        (own,) = sent
        assert len(own) <= 3 and sum(len(ids) for ids, _ in own) == 100 and all(len(ids) < 60 for ids, _ in own)


def test_a_large_benchmark_is_joined_in_one_pass_over_the_texts(spark, monkeypatch):
    """What tasks get doesn't grow with the benchmark, and few positions go beyond it."""
    sizes = []
    for n in (50, 400):
        monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 2000)
        monkeypatch.setattr(decontaminate, "FILTER_BITS", 20)
        bench = spark.createDataFrame([(k, " ".join(f"v{k}x{j}" for j in range(100))) for k in range(n)], "item_id long, text string")
        rows = [(k, " ".join(f"v{k}x{j}" for j in range(20, 60)) + " and more") for k in range(0, n, 7)] + [(1000 + k, " ".join(f"u{k}x{j}" for j in range(300))) for k in range(20)]
        sent, staged, broadcast, real = [], {}, spark.sparkContext.broadcast, decontaminate.stage
        monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: (sent.append(x), broadcast(x))[1])  # noqa: B023
        monkeypatch.setattr(decontaminate, "stage", lambda df, tag: staged.setdefault(tag, real(df, tag)))  # noqa: B023
        got = {r.doc_id: (r.bench_items, [tuple(s) for s in r.bench_spans]) for r in decontaminate.find_benchmark(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
        monkeypatch.undo()
        assert got == {k: ([str(k)], [(0, 40)]) if k < 1000 else ([], []) for k, _ in rows}
        ((tables, bits),) = sent
        sizes.append(sum(t.nbytes for t in tables.values()) + bits.nbytes)
        assert staged["candidates"].count() <= 1.2 * 28 * len(range(0, n, 7)) + 5
    assert sizes[0] == sizes[1]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.bench_items for r in decontaminate.find_benchmark(docs, bench).collect()] == [[]]
    assert decontaminate.find_benchmark(docs.limit(0), bench).count() == 0


def test_shift_skips_words_of_no_window():
    table = decontaminate.matchers([("1", b"a b c d e f g h i j k l m n")])[0]
    assert table.m == 13 and len(table.bucket) == 2 and min(table.shift.values()) == 0
    words = [b"x"] * 100 + [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h", b"i", b"j", b"k", b"l", b"m", b"n"]
    assert table.find(words) == ([[100, 114]], {"1"})
