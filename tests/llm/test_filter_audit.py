import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
WHITE = " \t\n\v\f\r"


def failing(text, copy):
    words, word = [], ""
    for c in text + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
    out |= {"D"} if any(c in "#$%&*|" for c in text) else set()
    return out | ({"E"} if copy else set())


def plain(docs, labels):
    docs = [(i, t or "", s or "") for i, t, s in docs]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    rows = [(s, failing(t, i is not None and i > least[t]), i in good, i in toxic) for i, t, s in docs]
    out, shapley = [], Counter()
    for part in {s for s, *_ in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] for r in own) - len(gone)
                left = [r for r in left if f not in r[0]]
                shapley[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), redundant, sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone), f])
    return sorted((*r[:9], shapley[r[0], r[9]]) for r in out)


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*x, "A", 5) for x in docs], "doc_id long, text string, source string, part string, mask int").repartition(3)
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, source string")
    out = filter_audit.audit(d, known)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def some_docs(rng, n):
    words = ["a", "b", "Word", "é", "日本", "x$", "Q|", "#", "nul\x00l", "\u00a0", "\x1c", *(f"w{k}" for k in range(300))]
    texts = ["", None, " \t", "A", "\x0b", *("".join(rng.choice(words[: rng.choice([3, 9, 311])]) + rng.choice([" ", "\n", "  ", "\r\n", "\x0c"]) for _ in range(rng.choice([2, 150, 199, 200, 201, 400]))) for _ in range(n // 3))]
    return [(k, rng.choice(texts), rng.choice(["s", "t", "", None])) for k in range(n)]


def test_it_counts_what_a_plain_version_counts(spark, monkeypatch):
    rng = random.Random(1)
    docs = some_docs(rng, 120)
    docs += [(rng.randrange(-20, 200), "the same text", rng.choice("uv")) for _ in range(80)] + docs[:7] * 2 + [(None, "the same text", "u"), (None, None, None), (None, "alone", "z")]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None, 2]), rng.choice([0, 1, None])) for i in range(-20, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    want = plain(docs, labels)
    assert audited(spark, docs, labels) == want
    monkeypatch.setattr(filter_audit, "SEEN_BYTES", 400)
    assert audited(spark, docs, labels) == want


def test_no_rows_and_no_labels(spark):
    assert audited(spark, [], []) == []
    docs = [(1, "a", None), (2, "a", "")]
    out = audited(spark, docs, [])
    assert out == plain(docs, []) and len(out) == 600 and {r[0] for r in out} == {""}


def test_texts_of_one_fingerprint_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda _: 7)
    rows = [(k, "s", t) for k, t in ((5, b"x"), (3, b"y"), (4, b"x"), (9, b"y"), (4, b"x"), (6, b"z"))]
    for parts in ([rows], [rows[:3], rows[3:]], [[r] for r in rows]):
        routed = [x for p in parts for x in filter_audit._route(iter(p))]
        copies = Counter()
        for id_, _, mask, n in filter_audit._settle(iter(routed)):
            copies[id_, mask & filter_audit.COPY > 0] += n
        assert copies == {(5, True): 1, (3, False): 1, (4, False): 2, (9, True): 1, (6, False): 1}


def test_a_text_leaves_a_task_once_however_many_copies_it_has():
    text = b"many words " * 100
    routed = list(filter_audit._route((k, "s", text) for k in range(5000, 0, -1)))
    assert sum(x[1][0] is not None for x in routed) == 1 and len(routed) == 5000


def test_only_a_hash_exchange_moves_texts_and_long_texts_are_whole(spark):
    long = "word " * 400_000 + "#"
    df = spark.createDataFrame([(1, long, "a"), (2, long, "a"), (3, long[:-1], "b")], "doc_id long, text string, source string")
    got = {(r.id, r.source): r["mask"] for r in filter_audit.failed_filters(df).collect()}
    assert got == {(1, "a"): 0b01010, (2, "a"): 0b11010, (3, "b"): 0b00010}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_sql_gives_the_same_rows(spark, sf):
    import duckdb

    from lakeloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({filter_audit.SQL})").fetchall())
    got = queries.op12_filter_audit(spark, f"/root/testdata/{sf}")
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == want
    assert got.where(F.col("removed") > 0).count() > 0
