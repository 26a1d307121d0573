import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lakeloom.llm import sharding


def test_flow_keeps_the_bounds_and_moves_little():
    rng = np.random.default_rng(1)
    keys = [str(k) for k in range(20_000)]
    ring, grown = sharding.Ring(40), sharding.Ring(41)
    shard, more = ring.shard[ring.arcs(keys)], grown.shard[grown.arcs(keys)]
    assert set(more[shard != more]) == {40}
    counts = rng.integers(0, 30, len(ring.at))
    for slack in (0.0, 0.05, 0.5):
        room = sharding.capacities(int(counts.sum()), 40, slack)
        flows = sharding.flow(ring, counts, room)
        by_arc, by_shard = Counter(), Counter()
        for arc, s, n in flows:
            by_arc[arc] += n
            by_shard[s] += n
        assert all(by_arc[k] == n for k, n in enumerate(counts.tolist()))
        assert all(by_shard[s] <= room[s] for s in range(40))


def test_movement_with_slack_is_far_below_a_rehash():
    keys = [str(k) for k in range(40_000)]

    def placed(shards, slack):
        ring = sharding.Ring(shards)
        arcs = ring.arcs(keys)
        order = np.argsort(arcs, kind="stable")
        counts = np.bincount(arcs, minlength=len(ring.at))
        places = sharding.Places(sharding.flow(ring, counts, sharding.capacities(len(keys), shards, slack)), counts)
        out = np.empty(len(keys), int)
        rank = np.arange(len(keys)) - (np.cumsum(counts) - counts)[arcs[order]]
        out[order] = places.place(arcs[order], rank)[0]
        return out

    assert (placed(40, 0.25) != placed(41, 0.25)).mean() < 0.04
    assert (placed(40, 0.0) != placed(41, 0.0)).mean() < 0.06
    assert (np.arange(40_000) % 40 != np.arange(40_000) % 41).mean() > 0.9


def test_counts_slots_and_digests_of_odd_rows(spark):
    rows = [(k, f"text {k}", "x") for k in range(500)] + [(7, "hot", "x")] * 300 + [(None, None, "x")] * 45 + [(900, "", None), (901, "é" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)
    out = sharding.assign_shards(docs).toPandas()
    sizes = Counter(out["shard"])
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(40))
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    got = Counter(zip(out["doc_id"].fillna(-1), out["size"], out["text_crc32"], strict=True))
    assert got == Counter((-1 if k is None else k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, _ in rows)


def test_few_rows_and_none(spark):
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    few = sharding.assign_shards(spark.createDataFrame([(k, "t") for k in range(3)], "doc_id long, text string")).toPandas()
    assert few["shard"].nunique() == 3 and set(few["slot"]) == {0}


def clockwise(keys, shards, room, virtual_nodes):
    """Shard and slot of each key, walked point by point."""
    ring = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 7), s) for s in range(shards) for v in range(virtual_nodes))
    room, arcs = list(room), [[] for _ in ring]
    for k, key in enumerate(keys):
        h = xxhash.xxh64_intdigest(key, 11)
        arcs[next((i for i, (at, _) in enumerate(ring) if at >= h), 0)].append(k)
    shard, over = {}, []
    for arc, own in enumerate(arcs):  # every point serves its own keys first
        for k in own:
            if room[ring[arc][1]]:
                room[ring[arc][1]] -= 1
                shard[k] = ring[arc][1]
            else:
                over.append((arc, k))
    for arc, k in over:
        at = arc
        while not room[ring[at % len(ring)][1]]:
            at += 1
        room[ring[at % len(ring)][1]] -= 1
        shard[k] = ring[at % len(ring)][1]
    return shard


@pytest.mark.parametrize(("shards", "slack", "virtual_nodes"), [(5, 0.0, 8), (7, 0.2, 3), (40, 0.0, 4)])
def test_matches_a_clockwise_walk(spark, shards, slack, virtual_nodes):
    rng = random.Random(shards)
    ids = [rng.choice([3, rng.randrange(10**6)]) for _ in range(400)]
    rows = [(k, f"t{n}") for n, k in enumerate(ids)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shards, slack=slack, virtual_nodes=virtual_nodes).collect()
    want = clockwise([str(k) for k in ids], shards, sharding.capacities(len(ids), shards, slack), virtual_nodes)
    crc = {zlib.crc32(f"t{n}".encode()): n for n in range(len(ids))}
    assert {crc[r.text_crc32]: r.shard for r in out} == want
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(x == s for x in want.values())))
