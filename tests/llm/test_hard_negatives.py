import math
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, x0 string"


def plain(rows, positives=5, negatives=10, low=30, high=90):
    """All pairs, with Python's integers."""
    own = []
    for i, v, label, *_ in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        if sum(x * x for x in w) < 1 << 62:
            own.append((i, w, label))
    out = []
    for a, (i, v, label) in enumerate(own):
        if i % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, lab) for b, (j, w, lab) in enumerate(own) if a != b and len(w) == len(v)]
        near = sorted((s, j) for s, j, lab in scored if lab == label)[:positives]
        far = sorted((s, j) for s, j, lab in scored if lab != label)
        for s, p in near:
            fits = [(t, j) for t, j in far if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    out = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **more)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(rng, n, d, spread=0.6):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)], rng.randint(-2, 3)) for i in range(n)]


def test_it_finds_what_all_pairs_give(spark, monkeypatch):
    rng = random.Random(1)
    rows = clustered(rng, 400, 12)
    want = plain(rows)
    assert len(want) > 500 and mined(spark, rows) == want
    for name, size in (("ANCHOR_BLOCK", 7), ("ROW_BLOCK", 50), ("ANCHORS", 3), ("ROWS", 16), ("PAIRS", 5)):
        monkeypatch.setattr(hard_negatives, name, size)
    assert mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=3, low=-50, high=99) == plain(rows, 2, 3, -50, 99)


def test_ties_repeats_and_a_vector_with_a_third_of_all_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = clustered(rng, 120, 3) + [(i, [0.5, 0.25, -1.0], i % 3) for i in range(200, 280)]
    rows += rows[:30] + [(10, [0.5, 0.25, -1.0], 1)] * 3
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 40)
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = clustered(rng, 60, 4)
    inf, nan = math.inf, math.nan
    rows += [(100, None, 1), (110, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 4.0], 1), (120, [1.0, None, 0.0, 0.0], 1), (130, [inf, 0.0, 0.0, 0.0], 1), (140, [0.0, -inf, 0.0, nan], 1)]
    rows += [(150, [1e300, 0.0, 0.0, 0.0], 1), (160, [1e6, 2e6, -3e6, 0.1], 1), (161, [1e6, 2e6, -3e6, 0.2], 1), (162, [8e5, 1e6, -3e6, 0.2], 2), (170, [0.0] * 4, 1), (171, [0.001] * 4, 0)]
    rows += [(180, [1.0, 1.0], 1), (181, [2.0, 1.0], 1), (182, [1.0, 0.9], 2), (190, [], 1), (191, [], 1), (192, [], 2), (200, [1.0] * 5, 1), (0, [4e6] * 4, 1), (1, [4.1e6] * 4, 1), (2, [2e6] * 4, 0)]
    want = plain(rows)
    assert {160, 180, 190} <= {r[0] for r in want} and mined(spark, rows) == want


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 1)]) == []


def test_pairs_are_discarded_on_leading_components(spark, monkeypatch):
    """Where a few directions hold most of the vectors, few pairs are multiplied to the end."""
    import numpy as np

    rng = np.random.default_rng(4)
    v = np.floor(256 * rng.normal(size=(2000, 64)) * 0.8 ** np.arange(64))
    weight, axes = np.linalg.eigh(v.T @ v)
    rotation = hard_negatives.Rotation(axes[:, ::-1].copy(), (6, 16, 64))
    search = hard_negatives._Search({64: rotation}, 10, False, (30, 90))
    import pyarrow as pa

    columns = lambda a, b, label: [pa.array(np.arange(a, b)), pa.array(np.arange(a, b)), pa.array(np.full(b - a, label)), pa.array(v[a:b].astype(np.int64).tolist(), pa.list_(pa.int64()))]
    scores = v[:20] @ v[20:].T
    top = np.sort(scores, axis=1)[:, -3].astype(int).tolist()
    search.ask([*columns(0, 20, 0), pa.array([[{"rank": 1, "id": 0, "score": s}] for s in top])])
    seen, take = [], search._take
    monkeypatch.setattr(search, "_take", lambda a, who, *x: (seen.append(len(who)), take(a, who, *x)))
    search.feed(columns(20, 2000, 1))
    assert sum(seen) < 0.1 * 20 * 1980
    found = search.end().to_pylist()
    for a in range(20):
        low, high = -(-30 * top[a] // 100), 90 * top[a] // 100
        want = sorted((-s, 20 + k) for k, s in enumerate(scores[a].astype(int).tolist()) if low <= s <= high)[:10]
        assert [(-r["score"], r["id"]) for r in found if r["anchor_id"] == a] == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_sql_gives_the_same_rows(spark, sf):
    import duckdb

    from lakeloom.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({hard_negatives.SQL})").fetchall())
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, f"/root/testdata/{sf}").select(names).collect())
    assert got == want and len(want) > 100
