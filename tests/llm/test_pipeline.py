"""The pipeline against a plain version of each of its stages."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_decontaminate import naive as naive_contamination
from test_line_dedup import naive as naive_units
from test_quality import plain_features
from test_simhash import brute_components
from test_simhash import naive as naive_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from lakeloom.llm import packing, quality
from lakeloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_firsts(docs):
    """Of the documents, in order of id, the first of each component by pairs of a Jaccard similarity of 0.8 or by equal texts."""
    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: a[0] == b[0] or bool(a[1] | b[1]) and 9 * len(a[1] & b[1]) >= 4 * (len(a[1]) + len(b[1]))
    first = {}
    for d, root in zip(docs, brute_components([(t or "", s) for (_, t), s in zip(docs, sets, strict=True)], near), strict=True):
        first.setdefault(root, d)
    return sorted(first.values())


def plain(docs, labels, benchmark):
    """(id, text) of what is left before packing; docs in order of id."""
    marks = {}
    for key, q in labels:
        marks.setdefault(key, []).append(q)
    train = [(plain_features(t), sum(marks[k]) / len(marks[k]) > 0.5) for k, t in docs if k in marks and zlib.crc32(str(k).encode()) % 3 != 1]
    model = quality.BradleyTerry(np.array([x for x, _ in train]), np.array([y for _, y in train]))
    docs = [(k, t) for k, t in docs if model.score(np.array([plain_features(t)]))[0] >= 0.5]
    fps = [naive_fingerprint(t, 5) for _, t in docs]
    first = {}
    for (k, t), root in zip(docs, brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3), strict=True):
        first.setdefault(root, (k, t))
    docs = sorted(first.values())
    docs = near_firsts(docs)
    cleaned = naive_units(docs)
    docs = [(k, cleaned[k][0]) for k, _ in docs if not cleaned[k][1] or cleaned[k][0].strip()]
    return [d for d, verdict in zip(docs, naive_contamination([t for _, t in docs], benchmark), strict=True) if not verdict[-1]]


def test_run_matches_a_plain_version(spark):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).orderBy(cols[0]).collect()]
    left = plain(read("documents", "doc_id", "text"), read("labels", "doc_id", "quality"), read("benchmark", "item_id", "text"))
    tokenizer, want = Tokenizer.from_file(packing.TOKENIZER), Counter()
    for key, text in left:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want[(key, piece, start, len(own), zlib.crc32(own.tobytes()))] += 1
    out = queries()["pipeline"](spark, SF).toPandas()
    assert Counter(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 4096


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, SF)
        assert docs.schema.simpleString() == spark.read.parquet(f"{SF}/documents.parquet").schema.simpleString()


GOOD = " ".join(f"word{k} and so" for k in range(20))


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_pass_every_stage(spark, stage):
    edit = " ".join(f"other{k} words" for k in range(100))
    rows = [(20, edit, "en", "s", 1), (21, edit + " and more", "en", "s", 1), (22, edit.replace("other50", "changed"), "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (None, GOOD, "en", "s", 1), (None, GOOD, None, "s", 1), (None, None, None, None, None), (3, GOOD + " x", "en", "s", 9), (3, GOOD + " x", "en", "s", 9), (4, GOOD * 300, "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    apply = corpus_pipeline.STAGES[stage][1]
    out = apply(spark, spark.createDataFrame(rows, schema), SF).collect()
    texts = sorted(((r.doc_id, r.text) for r in out), key=repr) if stage < 4 else None
    if stage == 0:
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        train = {k: (plain_features(t), labels[k] > 0.5) for k, t, *_ in rows if k in labels and zlib.crc32(str(k).encode()) % 3 != 1}
        model = quality.BradleyTerry(np.array([train[k][0] for k in sorted(train)]).reshape(-1, quality.N_FEATURES), np.array([train[k][1] for k in sorted(train)], bool))
        assert texts == sorted(((k, t) for k, t, *_ in rows if model.score(np.array([plain_features(t or "")]))[0] >= 0.5), key=repr)
    if stage == 2:
        cleaned = naive_units(list({(-1 if k is None else k, t) for k, t, *_ in rows if t is not None}))
        want = [(k, t if t is None else cleaned[-1 if k is None else k][0]) for k, t, *_ in rows]
        assert texts == sorted(((k, t) for k, t in want if t is None or t.strip() or not cleaned[-1 if k is None else k][1]), key=repr)
        assert all(r.n_chars == len(r.text) for r in out if r.text is not None and r.doc_id in (3, 4))
    if stage == 3:
        assert texts == sorted(((k, t) for k, t, *_ in rows), key=repr)
    if stage == 1:
        order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        docs = sorted({(k, t) for k, t, *_ in rows}, key=order)
        fps, first = [naive_fingerprint(t or "", 5) for _, t in docs], {}
        for d, root in zip(docs, brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3), strict=True):
            first.setdefault(root, d)
        ranked = sorted(first.values(), key=order)
        near, first = [(t or "", shingles(t)) for _, t in ranked], {}
        for d, root in zip(ranked, brute_components(near, lambda a, b: a[0] == b[0] or bool(a[1] | b[1]) and 9 * len(a[1] & b[1]) >= 4 * (len(a[1]) + len(b[1]))), strict=True):
            first.setdefault(root, d)
        assert Counter(r.doc_id for r in out) == Counter(k for k, _ in first.values()) and {r.text or "" for r in out} == {t or "" for _, t in first.values()}
    if stage == 4:
        assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in out}) == len(out) >= len(rows)
    assert apply(spark, spark.createDataFrame([], schema), SF).count() == 0
