"""Repeated units against a plain pass over all documents in order of ids."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from lakeloom.llm import line_dedup
from lakeloom.llm.queries import _cut_figures


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def naive_units(text, unit, least, passage):
    """(start, end, words) of all units, by the definition."""
    sep, at, pieces, out = {"line": "\n", "paragraph": "\n\n"}[unit], 0, [], []
    for piece in text.split(sep):
        pieces.append((at, at + len(piece), tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(piece)))))
        at += len(piece) + len(sep)
    for k, (a, b, norm) in enumerate(pieces):
        if len(norm) >= max(1, least):
            out.append((a, b, norm))
        elif norm:
            together = ()
            for _, b, more in pieces[k:]:
                together += more
                if len(together) >= least:
                    out.append((a, b, together))
                    break
    if whole := sum((norm for _, _, norm in pieces), ()):
        out.append((0, len(text), whole))
    if passage:
        words, run = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", lower(text))], (passage + 1) // 2
        digest = lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "little") % 2**40
        value = [sum(digest(w[2]) for w in words[k : k + run]) * 0x9E3779B97F4A7C15 % 2**64 >> 24 for k in range(len(words) - run + 1)]
        marked = {min(range(k, k + passage - run + 1), key=lambda j: (value[j], -j)) for k in range(len(words) - passage + 1)}
        out += [(words[k][0], words[k + run - 1][1], tuple(w[2] for w in words[k : k + run])) for k in marked]
    return out


def naive(rows, unit="line", least=25, passage=51):
    """Text and spans of each id; rows of (id, text) with distinct ids."""
    first, docs, out = {}, {}, {}
    for key, text in sorted(rows):
        docs[key] = sorted(naive_units(text, unit, least, passage))
        for a, b, words in docs[key]:
            first.setdefault(words, (key, b))
    for key, text in sorted(rows):
        cut = [(a, b) for a, b, words in docs[key] if first[words][0] != key or a >= first[words][1]]
        spans = []
        for a, b in sorted(cut):
            if spans and a <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        gone = set()
        for a, b in spans:
            gone |= set(range(a, b)) | ({a - 1} if a and (text[a - 1] != "\n" or b == len(text)) else {b})
        out[key] = ("".join(c for k, c in enumerate(text) if k not in gone), spans)
    return out


def wrapped(words, rng, most):
    return "".join(w + ("\n" if rng.random() < 1 / most else rng.choice([" ", "  ", "\t"])) for w in words).strip()


def some_docs(seed, n=80):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(900)}é" for _ in range(rng.randint(8, 40))] for _ in range(12)] + [["la"] * 60]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [f"own{rng.randrange(10**6)}" for _ in range(rng.randint(0, 6))] + rng.choice(passages)
        rows.append((k, wrapped([w.upper().replace("É", "é") if rng.random() < 0.2 else w for w in words], rng, rng.choice([3, 8, 100]))))
    return rows


@pytest.mark.parametrize(("unit", "least", "passage"), [("line", 4, None), ("paragraph", 4, None), ("line", 12, 11), ("line", 25, 20)])
def test_matches_a_plain_pass_in_order_of_ids(spark, unit, least, passage):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["ab", "É", "cd", "x.", "日本"]) for _ in range(rng.randint(0, 7))) for _ in range(25)]
    rows = [(k, rng.choice(["\n", "\n\n"]).join(rng.choice([p, p.upper().replace("É", "É"), p.replace(" ", "  ")]) for p in rng.choices(pool, k=rng.randint(1, 9)))) for k in range(60)]
    rows += [(100 + k, t) for k, t in some_docs(5)]
    docs = spark.createDataFrame([(k, t, [1], None, 5, "x") for k, t in rows], "doc_id long, text string, removed_spans array<int>, h1 string, mark int, `key` string").repartition(4)
    out = line_dedup.dedup_units(docs, unit=unit, min_words=least, passage=passage)
    assert sorted(out.columns) == sorted(docs.columns)
    want, original = naive(rows, unit, least, passage), dict(rows)
    assert sum(bool(spans) for _, spans in want.values()) > 20
    for r in out.collect():
        assert (r.text, [tuple(s) for s in r.removed_spans]) == want[r.doc_id], r.doc_id
        assert r.mark == 5 and r["key"] == "x"
        kept = "".join(" " if any(a <= k < b for a, b in want[r.doc_id][1]) else c for k, c in enumerate(original[r.doc_id]))
        assert r.text.split() == kept.split()


def test_sql_matches_a_plain_pass():
    rows = some_docs(7, 60) + [(100 + k, " ".join(f"p{j}" for j in range(k % 3, 90)) + f"\nend {k}") for k in range(5)] + [(200, ""), (201, "short")]
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
        got = {r[0]: r[1:] for r in db.sql(f"SELECT doc_id, text, removed_at, removed_chars, n_removed FROM ({line_dedup.SQL})").fetchall()}
    want = naive(rows)
    assert sum(bool(spans) for _, spans in want.values()) > 4
    assert got == {k: (text, ",".join(str(a) for a, _ in spans), sum(b - a for a, b in spans), len(spans)) for k, (text, spans) in want.items()}


LINE = " ".join(f"w{k}" for k in range(60))


def test_odd_rows(spark):
    long = "\n".join(f"{LINE} {k % 2000}" for k in range(4000))
    rows = [(1, None), (2, ""), (3, LINE), (4, f"own\n{LINE.upper()}\nend"), (5, LINE), (6, "\n".join([LINE] * 3)), (None, LINE), (None, f"null {LINE}"), (8, "same"), (8, "same"), (9, f"x\n{LINE}"), (9, f"x\n{LINE}"), (10, "short line"), (11, "short line")]
    for passage in (None, 51):
        out = line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), passage=passage).collect()
        assert len(out) == len(rows)
        text = {}
        for r in out:
            text.setdefault(r.doc_id, []).append(r.text)
        assert text[1] == [None] and text[2] == [""] and text[3] == [""] and text[4] == ["own\nend"] and text[5] == [""] and text[6] == [""]
        assert any(LINE in t for t in text[None]) and text[8] == ["same"] * 2 and text[9] == ["x"] * 2
        assert text[10] == ["short line"] and text[11] == [""]
    out = line_dedup.dedup_units(spark.createDataFrame([(7, long)], "doc_id long, text string"), passage=None).first()
    assert out.text == "\n".join(long.split("\n")[:2000])


@pytest.mark.parametrize("seed", range(3))
def test_a_passage_goes_however_it_is_wrapped(spark, seed):
    rng = random.Random(seed)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(51)]
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(k, wrapped(own(rng.randint(0, 30)) + passage + own(rng.randint(0, 30)), rng, rng.choice([2, 6, 1000]))) for k in range(20)] + [(50, " ".join(own(300)))]
    out = {r.doc_id: r for r in line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out[0].text == rows[0][1] and out[50].text == rows[-1][1]
    for k in range(1, 20):
        left = out[k].text.split()
        assert len(out[k].removed_spans) == 1 and max(sum(w in left for w in passage), 0) <= 25
        assert [w for w in left if w not in passage] == [w for w in rows[k][1].split() if w not in passage]


def test_short_copies_and_short_lines_in_a_row_go(spark):
    rng = random.Random(9)
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    verse = [own(9) for _ in range(4)]
    rows = [(1, "A few words"), (2, "a  few\nwords"), (3, "A few words more"), (4, "one\n\ntwo\n"), (5, "one two"), (6, "  \n"), (7, " ")]
    rows += [(10, "\n".join([own(3), *verse, own(4)])), (11, "\n".join([own(12), verse[0], "", *verse[1:], own(2)])), (12, "\n".join([own(12), verse[0], own(20), verse[1]]))]
    out = {r.doc_id: r.text for r in line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert [out[k] for k in range(1, 8)] == ["A few words", "", "A few words more", "one\n\ntwo\n", "", "  \n", " "]
    assert out[10] == rows[7][1] and out[12] == rows[9][1]
    lines = rows[8][1].split("\n")
    assert out[11] == "\n".join([lines[0], lines[-1]])


def test_figures_and_empty_table(spark):
    none = line_dedup.dedup_units(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0
    got = _cut_figures(line_dedup.dedup_units(spark.createDataFrame([(1, LINE), (2, f"a\n{LINE}\nb")], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, "", LINE), (2, 1, len(LINE), "2", "a\nb")]
