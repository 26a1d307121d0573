"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import slices, stage, utf8

SHARDS = 40
#: Points on the ring for each shard.
VIRTUAL_NODES = 128


class Ring:
    """Points of all shards in the order of their hashes.

    A shard's points depend on its number alone, so one more shard only adds
    points: what lies before each of these is all that moves, but for keys
    displaced by full shards.
    """

    def __init__(self, shards: int, virtual_nodes: int = VIRTUAL_NODES):
        points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 7), s) for s in range(shards) for v in range(virtual_nodes))
        self.at = np.array([p for p, _ in points], np.uint64)
        self.shard = np.array([s for _, s in points], np.int64)

    def arcs(self, keys: list[str]) -> np.ndarray:
        """The index of the first point clockwise of each key's hash."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(k, 11) for k in keys), np.uint64, len(keys))
        return np.searchsorted(self.at, hashes, "left") % len(self.at)


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold: ceil((1 + slack) rows / shards).

    Without slack the bounds add up to ``rows`` exactly, the first shards
    having the rows left over, so that counts are at most one apart.
    """
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flow(ring: Ring, counts: np.ndarray, room: list[int]) -> list[tuple[int, int, int]]:
    """(arc, shard, rows): how many of each arc's keys go to which shard.

    Every arc first fills its own shard, in ring order, as far as it has
    room. The rest then continue clockwise, arc after arc, into the first
    shards that aren't full. The work depends on the ring's size alone.
    """
    room, out, over = list(room), [], []
    for arc, n in enumerate(counts.tolist()):
        s = int(ring.shard[arc])
        own = min(n, room[s])
        room[s] -= own
        if own:
            out.append((arc, s, own))
        over.append(n - own)
    for arc, n in enumerate(over):
        at = arc
        while n:
            s = int(ring.shard[at])
            if used := min(n, room[s]):
                room[s] -= used
                out.append((arc, s, used))
                n -= used
            at = (at + 1) % len(over)
    return out


class Places:
    """Shard and slot of a key by its arc and its rank there."""

    def __init__(self, flows: list[tuple[int, int, int]], counts: np.ndarray):
        self.before = np.cumsum(counts) - counts
        filled: dict[int, int] = {}
        shard, slot, size = [], [], []
        for _, s, n in sorted(flows, key=lambda x: x[0]):
            shard.append(s)
            slot.append(filled.get(s, 0))
            size.append(n)
            filled[s] = filled.get(s, 0) + n
        self.shard, self.slot = np.array(shard, np.int32), np.array(slot, np.int64)
        self.ends = np.cumsum(np.array(size, np.int64))
        self.starts = self.ends - np.array(size, np.int64)

    def place(self, arc: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.before[arc] + rank
        k = np.searchsorted(self.ends, rank, "right")
        return self.shard[k], self.slot[k] + rank - self.starts[k]


def _ranked(ring: Ring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, seen = TaskContext.get().partitionId(), [0] * len(ring.at)
        for part in slices(batches, 4096):
            texts = utf8(part.column(1))
            arcs, ranks = ring.arcs(["" if k is None else str(k) for k in part.column(0).to_pylist()]), []
            for arc in arcs.tolist():
                ranks.append(seen[arc])
                seen[arc] += 1
            n = part.num_rows
            sizes, crcs = [len(t or b"") + 16 for t in texts], [zlib.crc32(t or b"") for t in texts]
            arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(arcs.astype(np.int32)), pa.array(np.full(n, part_id, np.int32)), pa.array(ranks, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "size", "text_crc32", "arc", "part", "rank"])

    return run


def assign_shards(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``, a row for each row of ``docs``.

    A key is the id as text (a null id: empty); its shard is that of the next
    point clockwise, or of the first shard after it that isn't full. Shards
    hold at most ``capacities`` rows; without slack their counts are at most
    one apart. Slots are gapless from 0. A size is the text's UTF-8 bytes
    plus 16, a null text having none.

    Only the rows of each arc (shards times virtual nodes) are counted and
    planned on the driver. A row's rank in its arc is the rank within its
    task plus the rows of that arc in the tasks before, so an id that a third
    of the rows share is spread like any overflow and never gathered. Which
    of the rows of an arc overflow depends on the order of the input. Long
    texts are only measured; an empty table gives no rows; other columns
    aren't used, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ring = Ring(shards, virtual_nodes)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = stage(own.mapInArrow(_ranked(ring), f"doc_id {kind}, size long, text_crc32 long, arc int, part int, rank long"), "keys")
    counts = stage(keyed.groupBy("arc", "part").agg(F.count("*").alias("n")), "arcs")
    by_arc = np.zeros(len(ring.at), np.int64)
    for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect():
        by_arc[r.arc] = r.n
    places = docs.sparkSession.sparkContext.broadcast(Places(flow(ring, by_arc, capacities(int(by_arc.sum()), shards, slack)), by_arc))
    earlier = F.sum("n").over(Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("arc", "part", F.coalesce(earlier, F.lit(0)).cast("long").alias("base"))
    ranked = keyed.join(bases, ["arc", "part"]).select("doc_id", "size", "text_crc32", "arc", (F.col("base") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            shard, slot = places.value.place(x["arc"].to_numpy(), x["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*x.columns[:-2], pa.array(shard), pa.array(slot)], [*x.schema.names[:-2], "shard", "slot"])

    return ranked.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
