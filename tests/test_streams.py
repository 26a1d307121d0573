"""Streams of several batches against plain versions."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from lakeloom.streaming import queries as streaming

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def stamp(minute):
    return f"2024-01-{1 + minute // 1440:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00"


def batches_of(spark, folder, batches):
    """A stream with a file for each batch of (id, minute, user, type)."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        own = [{"event_id": i, "ts": stamp(m), "user_id": u, "event_type": t} for i, m, u, t in rows]
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, own)))
        os.utime(folder / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files come by age
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def plain_outer(left, right, end):
    """Pairs, and events without one whose half hour the end has passed; an end is the last minute less the hour."""
    pairs = [(a, b) for a, am, au, _ in left for b, bm, bu, _ in right if au == bu and am < bm <= am + 30]
    alone = [(a, None) for a, am, *_ in left if a not in {x for x, _ in pairs} and am + 30 <= end]
    return pairs, alone, [(None, b) for b, bm, *_ in right if b not in {y for _, y in pairs} and bm <= end]


@pytest.mark.parametrize("how", ["left_outer", "right_outer", "full_outer"])
def test_unmatched_events_come_when_the_watermark_passes(spark, tmp_path, how):
    rng = random.Random(3)
    left, right, n = [], [], 0
    for _ in range(70):
        n += 1
        (left if rng.random() < 0.5 else right).append((n, rng.randrange(0, 400), rng.randrange(4), "x"))
    left, right = sorted(left, key=lambda r: r[1]), sorted(right, key=lambda r: r[1])

    def cut(rows):
        """Three batches, rows at most 50 minutes out of order, then one far ahead."""
        moved = sorted(rows, key=lambda r: r[1] + rng.randrange(50))
        third = len(moved) // 3
        return [moved[:third], moved[third : 2 * third], moved[2 * third :]]

    lb, rb = cut(left), cut(right)
    late = (900, 5, 1, "x")
    lb += [[(901, 1000, 77, "x")], [late], [(903, 1001, 77, "x")]]
    rb += [[(902, 1000, 78, "x")], [], [(904, 1001, 78, "x")]]
    out = streaming.joined_outer(batches_of(spark, tmp_path / "l", lb), batches_of(spark, tmp_path / "r", rb), how=how)
    got = sorted(((r.first_id, r.second_id) for r in streaming.drain(out.select("first_id", "second_id")).collect()), key=repr)
    pairs, first, second = plain_outer(left, right, 940)
    want = pairs + (first if how != "right_outer" else []) + (second if how != "left_outer" else [])
    assert got == sorted(want, key=repr) and first and second


def test_the_outer_join_keeps_no_state_of_what_is_closed(spark, tmp_path):
    left = [[(k, 10 * k, k % 3, "x") for k in range(40)], [(100, 2000, 1, "x")], [(101, 4000, 1, "x")], [(102, 6000, 1, "x")]]
    right = [[(200 + k, 10 * k + 5, k % 3, "x") for k in range(40)], [(300, 2000, 2, "x")], [(301, 4000, 2, "x")], [(302, 6000, 2, "x")]]
    out = streaming.joined_outer(batches_of(spark, tmp_path / "l", left), batches_of(spark, tmp_path / "r", right))
    query = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    assert max(kept) >= 80 and kept[-1] <= 4


def plain_funnels(rows, steps, within):
    """All events of a user in order of time and id."""
    out = []
    for user in {u for _, _, u, _ in rows}:
        begun = {}
        for m, i, t in sorted((m, i, t) for i, m, u, t in rows if u == user):
            if t not in steps:
                continue
            k = steps.index(t)
            if k == 0:
                begun[1] = (m, i)
            elif k in begun and m - begun[k][0] <= within:
                first = begun.pop(k)
                if k + 1 == len(steps):
                    out.append((user, first[1], i, (m - first[0]) * 60_000))
                else:
                    begun[k + 1] = max(begun.get(k + 1, first), first)
    return sorted(out)


STEPS = ("view", "click", "purchase")


@pytest.mark.parametrize("seed", [1, 2])
def test_funnels_of_shuffled_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(0, 2000), rng.randrange(5), rng.choice([*STEPS, "other"])) for k in range(300)]
    moved = sorted(rows, key=lambda r: r[1] + rng.randrange(55))
    batches = [moved[k : k + 60] for k in range(0, 300, 60)] + [[(999, 9000, 99, "view")]]
    want = plain_funnels(rows, STEPS, 300)
    out = streaming.funnels(batches_of(spark, tmp_path / "in", batches), within_hours=5)
    got = sorted(tuple(r) for r in streaming.drain(out).collect())
    assert got == want and len(want) > 10


def test_funnels_of_all_events(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type").collect()
    ms = lambda t: (t - datetime(2024, 1, 1)) // timedelta(milliseconds=1)
    passed = ms(max(r.ts for r in rows)) - 3_600_000
    events = [(r.event_id, ms(r.ts), r.user_id, r.event_type) for r in rows if ms(r.ts) <= passed]
    want = [(u, a, b, took // 60_000) for u, a, b, took in plain_funnels(events, STEPS, 24 * 3_600_000)]
    got = sorted(tuple(r) for r in entry.queries()["stream_funnels"](spark, sf).collect())
    assert got == sorted(want) and len(want) > 100
