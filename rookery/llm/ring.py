"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 32-bit ring, and a key belongs to the shard of the next point clockwise. Shards
have capacities; keys that find their shard full continue clockwise to the next point of a shard with room. With
capacities that add up to the number of rows (the default), counts differ by one at most; ``slack`` > 0 raises them to
(1 + slack) times the mean and moves fewer keys.

The walk needs only the number of keys on each arc between two points (shards x vnodes rows, whatever the input), so it
runs on the driver and yields segments: "of this arc, ranks a to b go to that shard". Tasks then rank the keys of each
arc and look their segment up. Texts are not shuffled.

Defined cases: the key of a row is its doc_id; rows with a null doc_id use the CRC of their text. Rows that agree in
everything are interchangeable. A null text has size 16 and CRC 0. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import saved

RING = 1 << 32
SUB_ARCS = 1 << 16


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard), clockwise. A shard's points do not depend on the number of shards."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big")
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def bounded_walk(owners: list[int], counts: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc, clockwise, the (shard, number of keys) that its keys go to, in the order of their ranks.

    First every arc fills its owner; then, arc by arc, what is left continues clockwise over points with room. Points of
    full shards are skipped for good, so the walk is almost linear.
    """
    n, room = len(owners), list(capacity)
    out: list[list[tuple[int, int]]] = [[] for _ in owners]
    left = list(counts)
    for i, s in enumerate(owners):
        if take := min(left[i], room[s]):
            out[i].append((s, take))
            left[i] -= take
            room[s] -= take
    nxt = [(i + 1) % n for i in range(n)]

    def open_point(i: int) -> int:
        trail = []
        while not room[owners[i]]:
            trail.append(i)
            i = nxt[i]
        for t in trail:
            nxt[t] = i
        return i

    for i in range(n):
        at = i
        while left[i]:
            at = open_point(at)
            take = min(left[i], room[owners[at]])
            out[i].append((owners[at], take))
            left[i] -= take
            room[owners[at]] -= take
    return out


def assign(docs: DataFrame, shards: int = 40, vnodes: int = 256, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard), a row per row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc "), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("_at", F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"))
    points = ring_points(shards, vnodes)
    positions = [p for p, _ in points]
    # every 1/SUB_ARCS of the ring is cut at the points inside it, so a sub-arc has one owner
    cuts = sorted({*(k * (RING // SUB_ARCS) for k in range(SUB_ARCS)), *(p + 1 for p in positions if p + 1 < RING)})
    owners = [points[k][1] if (k := bisect_left(positions, c)) < len(points) else points[0][1] for c in cuts]
    grid = {}
    for i, c in enumerate(cuts):
        grid.setdefault(c // (RING // SUB_ARCS), []).append((c, i))
    arcs = [(cell, c, nxt, i) for cell, x in grid.items() for (c, i), nxt in zip(x, [y for y, _ in x[1:]] + [RING], strict=True)]
    arcs = F.broadcast(spark.createDataFrame(arcs, "_cell long, _from long, _to long, _arc int"))
    rows = rows.withColumn("_cell", F.expr(f"_at div {RING // SUB_ARCS}")).join(arcs, "_cell").where("_at >= _from and _at < _to").drop("_cell", "_from", "_to")
    rows = saved(rows, "ring-keys")
    counts = [0] * len(cuts)
    for arc, n in rows.groupBy("_arc").count().collect():  # at most SUB_ARCS + shards x vnodes rows
        counts[arc] = n
    total = sum(counts)
    limit = -(-total * (1 + slack) // shards) if slack else 0
    capacity = [max(int(limit), total // shards + (s < total % shards)) for s in range(shards)]
    plan, slots = [], [0] * shards
    for arc, parts in enumerate(bounded_walk(owners, counts, capacity)):
        rank = 0
        for s, n in parts:
            plan.append((arc, rank, rank + n, s, slots[s] - rank))
            slots[s] += n
            rank += n
    plan = F.broadcast(spark.createDataFrame(plan, "_arc int, _lo long, _hi long, shard int, _shift long"))
    ranked = rows.withColumn("_rank", F.expr("row_number() over (partition by _arc order by _at, doc_id, size, text_crc32) - 1L"))
    ranked = ranked.join(plan, "_arc").where("_rank >= _lo and _rank < _hi")
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") + F.col("_shift")).alias("slot"))
