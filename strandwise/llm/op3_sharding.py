"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a 64-bit ring and a text belongs to the first
point clockwise of its hash.  A shard takes its own keys up to a capacity just
above the mean; what overflows travels clockwise, joins the queue of later
points and is taken by the next shards with room.  The walk is done on the
sums of the arcs, a number fixed by the ring and not by the data; rows only
look up where their place in ring order falls.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.ranked import before, in_order

SHARDS = 16
POINTS = 128
SLACK = 0.001


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions of all virtual nodes (signed, as Spark hashes are) and their shards."""
    at = np.array([xxhash.xxh64_intdigest(f"shard {s} point {p}") for s in range(shards) for p in range(points)], np.uint64).view(np.int64)
    owner = np.repeat(np.arange(shards), points)
    order = np.argsort(at, kind="stable")
    return at[order], owner[order]


def walk(loads: np.ndarray, owner: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """Intervals ``(start, end, shard)`` of ring order (in bytes) after the bounded-load walk.

    ``loads[i]`` is the sum over the arc that ends at point i.  Own keys come
    first; overflow queues clockwise, first come first taken.  Two rounds
    suffice, as after one every shard with room has met every queued key.
    """
    room = np.full(int(owner.max()) + 1, capacity, np.int64)
    ends = np.cumsum(loads)
    taken: list[tuple[int, int, int]] = []
    spill: list[tuple[int, int] | None] = []
    for i, (load, end) in enumerate(zip(loads.tolist(), ends.tolist(), strict=True)):
        s = int(owner[i])
        own = min(load, int(room[s]))
        room[s] -= own
        if own:
            taken.append((end - load, end - load + own, s))
        spill.append((end - load + own, end) if load > own else None)
    queue: deque[tuple[int, int]] = deque()
    for turn in range(2):
        for i in range(len(owner)):
            if turn == 0 and spill[i]:
                queue.append(spill[i])
            s = int(owner[i])
            while queue and room[s] > 0:
                a, b = queue.popleft()
                n = min(b - a, int(room[s]))
                room[s] -= n
                taken.append((a, a + n, s))
                if a + n < b:
                    queue.appendleft((a + n, b))
    return sorted(taken)


def shards(spark: SparkSession, docs: DataFrame, n: int = SHARDS, points: int = POINTS, slack: float = SLACK) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of ``docs(doc_id, text)``.

    Law ``bytes``: no shard exceeds ``(1 + slack)`` times the mean size by more
    than half a row at each end of an interval that it takes.  Equal texts share a ring position
    and stay together unless they overflow.  A null text has size 1; rows may
    repeat; ``doc_id`` may be null; other columns are ignored; an empty table
    gives no rows.
    """
    at, owner = ring(n, points)
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("pos"),
    )

    def annotate():
        total = [0]

        def add(batch):
            size = batch.column(1).to_numpy()
            starts = total[0] + np.cumsum(size) - size
            total[0] += int(size.sum())
            arc = np.searchsorted(at, batch.column(3).to_numpy()) % len(at)
            return {"start": pa.array(starts), "arc": pa.array(arc.astype(np.int32))}

        return add

    rows = in_order(spark, narrow, ["pos", "doc_id", "size"], "ring", annotate, "start bigint, arc int")
    sums = rows.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    bytes_before, rows_before = before({r.part: r.b for r in sums}), before({r.part: r.n for r in sums})
    total = sum(r.b for r in sums)
    # keys past the last point belong to the first, so ring order begins where they do
    arcs = {(r.arc, r.late): r.b for r in rows.groupBy("arc", (F.col("pos") > int(at[-1])).alias("late")).agg(F.sum("size").alias("b")).collect()}
    last = arcs.get((0, True), 0)
    loads = np.array([arcs.get((i, False), 0) + (last if i == 0 else 0) for i in range(len(at))], np.int64)
    capacity = -(-int(total * (1 + slack) + 1) // n)
    taken = walk(loads, owner, capacity)
    # in sorted order of positions the wrapped keys come last: rotate places by their sum
    starts = np.array([a for a, _, _ in taken], np.int64)
    shard_of = np.array([s for _, _, s in taken], np.int32)

    def intervals(batches):
        for batch in batches:
            cols = {c: batch.column(c).to_numpy() for c in ("part", "start", "nth", "size")}
            parts = cols["part"].tolist()
            start = cols["start"] + np.array([bytes_before[p] for p in parts], np.int64)
            # a row goes where its middle falls, so errors at the ends of intervals cancel
            k = np.searchsorted(starts, (start + cols["size"] // 2 + last) % max(total, 1), side="right") - 1
            nth = cols["nth"] + np.array([rows_before[p] for p in parts], np.int64)
            kept = {c: batch.column(c) for c in ("doc_id", "size", "text_crc32")}
            yield pa.RecordBatch.from_pydict(kept | {"k": pa.array(k.astype(np.int32)), "nth": pa.array(nth), "late": pa.array(start >= total - last)})

    spread = rows.mapInArrow(intervals, "doc_id bigint, size bigint, text_crc32 bigint, k int, nth bigint, late boolean")
    # a slot is the place in the interval plus the sizes of the shard's earlier intervals; the wrapped part of one is apart
    ends = sorted((r.k, not r.late, r.least, r.n) for r in spread.groupBy("k", "late").agg(F.min("nth").alias("least"), F.count("*").alias("n")).collect())
    filled: dict[int, int] = {}
    base = []
    for k, early, least, count in ends:
        s = int(shard_of[k])
        base.append((k, not early, s, filled.get(s, 0) - least))
        filled[s] = filled.get(s, 0) + count
    table = {(k, late): (s, b) for k, late, s, b in base}

    def slots(batches):
        for batch in batches:
            pairs = [table[x] for x in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            shard = pa.array([s for s, _ in pairs], pa.int32())
            slot = batch.column(4).to_numpy() + np.array([b for _, b in pairs], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), shard, pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    return spread.mapInArrow(slots, "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards(spark, spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
