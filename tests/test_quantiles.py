import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import summaries, tdigest

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def groups(rng):
    """One group with most of the rows, one with few values, odd ones."""
    rows = [("big", rng.lognormvariate(0, 4)) for _ in range(6000)] + [("few", rng.choice([1.0, 2.0, 2.5])) for _ in range(2000)]
    rows += [(None, float(k)) for k in range(40)] + [("one", 7.0), ("none", None), ("wide", 1e300), ("wide", -1e300), ("wide", 1e-300)] + [("big", None)] * 5
    return rows


@pytest.mark.parametrize(("few", "pieces"), [(2048, 64), (20, 64), (3, 4)])
def test_selected_quantiles_are_exact(spark, monkeypatch, few, pieces):
    monkeypatch.setattr(summaries, "FEW", few)
    monkeypatch.setattr(summaries, "PIECES", pieces)
    rows = groups(random.Random(1))
    df = spark.createDataFrame(rows, "who string, v double").repartition(4)
    got = {(r.g, r.j): r.value for r in summaries.quantiles(df, "who", "v", SHARES).collect()}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert len(got) == len(values) * len(SHARES)
    for g, own in values.items():
        own = sorted(own)
        for j, s in enumerate(SHARES):
            at = (len(own) - 1) * s
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert got[g, j] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12)


def test_no_window_runs_over_a_groups_rows(spark, monkeypatch):
    """The windows of the last round see a bounded part of a group with all rows."""
    monkeypatch.setattr(summaries, "FEW", 50)
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.rand(3).alias("v"))
    seen, real = [], summaries._narrowed
    monkeypatch.setattr(summaries, "_narrowed", lambda *x: (out := real(*x), seen.append(out[0].count()))[0])
    summaries.quantiles(df, "g", "v", [0.5]).collect()
    assert seen[0] < 200_000 / 20 and seen[-1] <= 50 and len(seen) <= 4


def test_digests_have_bounded_rank_errors_however_they_are_merged(spark, monkeypatch):
    rng = random.Random(2)
    rows = groups(rng) + [("inf", math.inf), ("inf", 1.0), ("inf", -math.inf), ("inf2", math.inf), ("nan", math.nan)]
    df = spark.createDataFrame(rows, "who string, v double").repartition(7)
    for held, fan in ((1 << 17, 256), (500, 2)):
        monkeypatch.setattr(tdigest, "HELD", held)
        monkeypatch.setattr(tdigest, "FAN_IN", fan)
        out = tdigest.quantiles_of(tdigest.tdigest(df, "who", "v"), SHARES)
        assert out.columns == ["who", "n", "low", "high", "quantiles"]
        got = {r.who: r for r in out.collect()}
        assert set(got) == {"big", "few", None, "one", "wide", "inf", "inf2"}
        for g in ("big", "few", None, "one"):
            own = np.array([v for who, v in rows if who == g and v is not None])
            assert (got[g].n, got[g].low, got[g].high) == (len(own), own.min(), own.max())
            for s, q in zip(SHARES, got[g].quantiles, strict=True):
                below, upto = (own < q).mean(), (own <= q).mean()
                assert below - 0.02 - 1 / len(own) <= s <= upto + 0.02 + 1 / len(own), (g, s, q)
        assert (got["inf"].low, got["inf"].high, got["inf"].n) == (-math.inf, math.inf, 3) and got["inf2"].n == 1


def test_a_digest_is_small_and_exact_at_the_ends():
    rng = np.random.default_rng(5)
    v = rng.pareto(1.5, 1_000_000)
    means, weights = tdigest.digest(v, np.ones(len(v)))
    assert len(means) <= tdigest.SIZE + 1 and weights.sum() == len(v) and weights[0] < 100 and weights[-1] < 100
    halves = [tdigest.digest(x, np.ones(len(x))) for x in np.array_split(v, 37)]
    merged = tdigest.digest(np.concatenate([m for m, _ in halves]), np.concatenate([w for _, w in halves]))
    shares = np.array([0.001, 0.01, 0.5, 0.99, 0.999])
    for m, w in ((means, weights), merged):
        got = tdigest.quantile(v.min(), v.max(), m, w, shares)
        ranks = (v[None, :] <= got[:, None]).mean(axis=1)
        assert (np.abs(ranks - shares) < np.array([0.0005, 0.002, 0.01, 0.002, 0.0005])).all()


def test_digests_of_no_rows(spark):
    none = spark.createDataFrame([], "who string, v double")
    assert tdigest.quantiles_of(tdigest.tdigest(none, "who", "v"), [0.5]).count() == 0
