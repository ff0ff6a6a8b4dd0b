"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Every shard owns ``vnodes`` points on a ring of ``CELLS`` cells; a key belongs to the first point at
or after its own cell. A shard takes no more than its bound; the keys of an arc that find it full
continue clockwise to the next shard on the ring with room. All keys of an arc meet the same shards
in the same order, so the overflow is settled on counts per arc (at most shards x vnodes numbers,
whatever the data), and a key's place follows from its rank inside its arc. Only keys of overflowing
arcs move; with ``epsilon=0`` shard counts differ by one at most (the law ``rows``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty

CELLS = 1 << 16
CELL_BITS = 16
#: Rows of an arc that are ordered in one task.
STRETCH = 1 << 20
RUN = 1 << 12


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in clockwise order; a taken cell passes the point to the next free one."""
    if n_shards * vnodes > CELLS // 4:
        raise ValueError("too many virtual nodes for the ring")
    taken: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(n_shards):
            cell = int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:4], "big") % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = s
    return sorted(taken.items())


def arc_of_cell(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(cell, arc) for each cell of the ring; arc i ends at point i."""
    out, at = [], 0
    for cell in range(CELLS):
        while at < len(points) and points[at][0] < cell:
            at += 1
        out.append((cell, at % len(points)))
    return out


def bounds(total: int, n_shards: int, epsilon: float) -> list[int]:
    """The most each shard may hold. With epsilon 0 they add up to the total and differ by one at most."""
    if epsilon == 0:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [-(-int(total * (1 + epsilon) * 1_000_000) // (n_shards * 1_000_000))] * n_shards


def settle(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, last rank + 1, shard, first slot).

    In each round every arc offers its waiting keys to its next shard clockwise, arcs in ring order;
    so keys keep their own shard wherever it has room, and walk on only from full ones.
    """
    room, used, n = list(room), [0] * len(room), len(points)
    waiting = {a: (0, counts[a]) for a in sorted(counts) if counts[a]}
    at, out = {a: a for a in waiting}, []
    for _ in range(n + 1):
        for a in list(waiting):
            low, high = waiting[a]
            shard = points[at[a]][1]
            take = min(room[shard], high - low)
            if take:
                out.append((a, low, low + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if low + take == high:
                del waiting[a]
            else:
                waiting[a] = (low + take, high)
                at[a] = (at[a] + 1) % n
        if not waiting:
            return out
    raise ValueError("the shards have no room for all keys")


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 24, vnodes: int = 64, epsilon: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    A null text counts as empty; a null key has one place on the ring like any other; repeated rows
    each get a slot of their own, ordered by key, checksum and size (rows equal in all are interchangeable).
    An empty table gives an empty result. Other columns are ignored.
    """
    points = ring_points(n_shards, vnodes)
    # CELLS rows of two numbers, fixed by the ring and not by the data: always small enough to send around.
    cells = F.broadcast(spark.createDataFrame(arc_of_cell(points), "cell int, arc int").coalesce(1))
    place = F.xxhash64(F.col(key))
    cell = F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int")
    counted = docs.select(cell.alias("cell")).groupBy("cell").count().join(cells, "cell").groupBy("arc").agg(F.sum("count").alias("n")).collect()
    counts = {r["arc"]: r["n"] for r in counted}
    segments = settle(points, counts, bounds(sum(counts.values()), n_shards, epsilon))
    # At most (shards x vnodes) arcs, each cut at most once per full shard: bounded by the ring.
    by_arc: dict[int, list] = {}
    for a, low, high, shard, slot in segments:
        by_arc.setdefault(a, []).append((high, shard, slot - low))
    plan = F.broadcast(spark.createDataFrame(sorted(by_arc.items()), "arc int, parts array<struct<upto: bigint, shard: int, shift: bigint>>").coalesce(1))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text_or_empty(text)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        cell.alias("cell"),
        place.alias("place"),
    )
    # Rows alike in all are counted and take slots one after another, so a key that many rows have is one row here. An arc of more
    # than ``STRETCH`` rows is ordered in stretches, each on its own; the stretches of an arc follow one another.
    alike = rows.groupBy("doc_id", "size", "text_crc32", "cell", "place").agg(F.count("*").alias("n")).join(cells, "cell")
    stretches = max(1, sum(counts.values()) // (len(points) * STRETCH))
    alike = alike.withColumn("stretch", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(stretches)))
    order = Window.partitionBy("arc", "stretch").orderBy("place", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = alike.withColumn("upto", F.sum("n").over(order))
    if stretches > 1:
        before = alike.groupBy("arc", "stretch").agg(F.sum("n").alias("in_stretch"))  # arcs x stretches rows
        upto = Window.partitionBy("arc").orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = before.withColumn("before", F.sum("in_stretch").over(upto) - F.col("in_stretch"))
        ranked = ranked.join(before.select("arc", "stretch", "before"), ["arc", "stretch"]).withColumn("upto", F.col("upto") + F.col("before"))
    # Slots of rows alike come in runs, so that no array is as long as a key is often.
    low = F.col("upto") - F.col("n")
    runs = ranked.withColumn("from", F.explode(F.sequence(low, F.col("upto") - 1, F.lit(RUN).cast("long"))))
    placed = runs.withColumn("rank", F.explode(F.sequence("from", F.least(F.col("from") + RUN, F.col("upto")) - 1))).join(plan, "arc")
    part = F.element_at(F.filter("parts", lambda p: F.col("rank") < p["upto"]), 1)
    return placed.withColumn("part", part).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows" if epsilon == 0 else "bounded").alias("law"),
        F.col("part.shard").alias("shard"),
        (F.col("rank") + F.col("part.shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
