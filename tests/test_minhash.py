import math
import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakeloom.operators import minhash

SCHEMA = "doc_id long, text string, node long, digest string"


def plain_set(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def plain_links(sets, p=4, q=5):
    """All pairs of a similarity of at least p / q, by the rarest shingles of each set: no such pair has none of these in common."""
    often = Counter(x for s in sets.values() for x in s)
    filed, links = {}, set()
    for node, own in sets.items():
        for x in sorted(own, key=lambda x: (often[x], x))[: len(own) - -(-p * len(own) // q) + 1]:
            for other in filed.setdefault(x, []):
                if (p + q) * len(own & sets[other]) >= p * (len(own) + len(sets[other])):
                    links.add((other, node))
            filed[x].append(node)
    return links


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def plain(docs):
    """(id, first of the text, first of the component) of each row."""
    texts = {t or "" for _, t in docs}
    root = roots(texts, plain_links({t: plain_set(t) for t in texts}))
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    first = {t: least(i for i, u in docs if (u or "") == t) for t in texts}
    named = {r: least(first[t] for t in texts if root[t] == r) for r in set(root.values())}
    return Counter((i, first[t or ""], named[root[t or ""]]) for i, t in docs)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        out[rng.randrange(len(out))] = f"n{rng.random()}"
    return " ".join(out)


def some_docs(rng, families=5):
    texts = []
    for _ in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        texts += [" ".join(base), *(edited(rng, base, rng.choice([0.001, 0.01, 0.02, 0.03, 0.1])) for _ in range(6))]
    texts += ["", None, " \n", "one", "One", "one two three four five", "ONE  two\tthree four five", "one two three four five six"]
    docs = list(enumerate(texts)) + [(rng.randrange(200), t) for t in texts[::3]]
    return docs + docs[:5] * 2 + [(None, texts[0]), (None, "no id here at all"), (None, None), (4, "an id that repeats")]


def found(spark, docs, **more):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).repartition(3)
    return Counter(map(tuple, minhash.near_duplicates(df, **more).collect()))


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    docs = some_docs(random.Random(1))
    want = plain(docs)
    for name, size in (("ASKED_BLOCK", 3), ("ROW_BLOCK", 5)):
        monkeypatch.setattr(minhash, name, size)
    # So many bands of few values that no pair is missed.
    assert found(spark, docs, bands=12, rows=2) == want


def test_a_large_group_hangs_together_though_its_texts_differ_from_its_least(spark):
    """Each text is near to the middle one only, which isn't the first of any bucket."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    docs = [(k, edited(rng, base, 0.022)) for k in range(30)] + [(1000, " ".join(base))] + [(2000 + k, edited(rng, base, 0.3)) for k in range(5)]
    sets = {k: plain_set(t) for k, t in docs}
    pairs = plain_links(sets)
    assert all((k, 1000) in pairs for k in range(30)) and len(pairs) < 0.5 * 30 * 30
    assert found(spark, docs, bands=12, rows=3) == plain(docs)


def test_one_of_each(spark):
    docs = some_docs(random.Random(3), 6)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).repartition(2)
    kept = minhash.one_of_each(df, bands=12, rows=3)
    assert kept.columns == df.columns
    texts = {t or "" for _, t in docs}
    root = roots(texts, plain_links({t: plain_set(t) for t in texts}))
    rows = kept.collect()
    assert Counter(root[r.text or ""] for r in rows) == Counter(set(root.values()))
    order = lambda i: (i is None, i or 0)
    for r in rows:
        assert order(r.doc_id) == min(order(i) for i, t in docs if root[t or ""] == root[r.text or ""])


def test_no_rows_and_no_links(spark):
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None), (2, ""), (3, " ")]) == Counter([(1, 1, 1), (2, 1, 1), (3, 3, 3)])


def test_signatures_agree_as_often_as_sets(spark):
    """The share of equal minima estimates the similarity; here each value is a band of its own."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    docs = [(k, edited(rng, base, share)) for k, share in enumerate((0.005, 0.02, 0.05, 0.1, 0.2))] + [(9, " ".join(base))]
    df = spark.createDataFrame(docs, "id long, text string")
    words = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
    hashed = df.select("id", F.lit(b"").alias("digest"), F.col("id").alias("row"), words.alias("w"))
    keys = {r.id: r["keys"] for r in hashed.mapInArrow(minhash._signatures(5, 400, 1), "id long, digest binary, row long, keys array<long>").collect()}
    whole = plain_set(docs[-1][1])
    for k, text in docs[:-1]:
        own = plain_set(text)
        exact = len(own & whole) / len(own | whole)
        assert abs(sum(a == b for a, b in zip(keys[k], keys[9], strict=True)) / 400 - exact) < 4 * math.sqrt(exact * (1 - exact) / 400) + 0.01


def test_recall_on_documents_and_nothing_spurious(spark):
    sf = "/root/testdata/sf0.1"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    first = {}
    for i, t in sorted(docs):
        first.setdefault(t, i)
    sets = {i: plain_set(t) for t, i in first.items()}
    pairs = plain_links(sets)
    got = {r.doc_id: (r.class_id, r.component_id) for r in entry.queries()["near_duplicate_texts"](spark, sf).collect()}
    assert all(got[i][0] == first[t] for i, t in docs)
    together = sum(got[a][1] == got[b][1] for a, b in pairs)
    exact = roots(sets, pairs)
    spurious = sum(exact[i] != exact[got[i][1]] for i in sets)
    print(f"links {len(pairs)}, found {together}, recall {together / len(pairs):.4f}, spurious {spurious} of {len(sets)}")
    assert len(pairs) > 30 and together >= 0.9 * len(pairs) and spurious == 0
