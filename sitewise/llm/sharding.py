"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual_nodes` points of the ring; the arc before a point belongs to its shard.
A key goes to the shard of its arc. A shard takes the keys of its own arcs, in ring order, until it
is full; the keys beyond that continue clockwise and fill the free places of the shards they pass,
first come first served, so no shard holds more than its capacity.

Only counts per arc reach the driver: shards x virtual_nodes numbers, whatever the number of rows.
They fix which stretch of each arc, by rank, lies in which shard. Ranks are window row numbers inside
hash buckets of bounded size plus the sizes of the earlier buckets.

Edge cases: a null id is a key of its own, a null text has size 1 and the checksum of the empty
text, equal rows are told apart by nothing and share out the places they get, an empty table gives
an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.llm.common import HASH_BITS, before, bucket_bits, md5_number

VIRTUAL_NODES = 128
#: Equal cells of the ring by which a key finds its arc with an equality join.
CELL_BITS = 12


def ring_hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring_points(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order."""
    return sorted((ring_hash(f"shard|{s}|{v}"), s) for s in range(shards) for v in range(virtual_nodes))


def ring_cells(points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, low, high, arc): the ring cut at its points and at equal cells; `high` is inclusive.

    Arc i ends at point i; what lies behind the last point belongs to arc 0 of the next turn, which
    is kept as arc `len(points)`, so that arcs follow the ring from position 0.
    """
    width = 1 << (HASH_BITS - CELL_BITS)
    cuts = [p for p, _ in points]
    out, low, arc = [], 0, 0
    while low < 1 << HASH_BITS:
        while arc < len(cuts) and cuts[arc] < low:
            arc += 1
        end = (low // width + 1) * width - 1
        high = min(end, cuts[arc]) if arc < len(cuts) else end
        out.append((low // width, low, high, arc))
        low = high + 1
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows a shard may hold. Without slack the counts are equal or differ by one."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def stretches(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, low rank, high rank, shard, slot of the low rank) that place every key of every arc.

    Two turns suffice: the first lets each shard take its own keys, the second and third carry what
    is left clockwise. The work is a loop over the ring's points, not over keys.
    """
    free, used, out = list(capacity), [0] * len(capacity), []
    waiting: deque[list[int]] = deque()

    def place(arc: int, low: int, count: int, shard: int) -> None:
        out.append((arc, low, low + count, shard, used[shard]))
        used[shard] += count
        free[shard] -= count

    own: list[tuple[int, int, int]] = []
    for arc, shard in enumerate(owners):
        n = counts.get(arc, 0)
        taken = min(n, free[shard])
        if taken:
            place(arc, 0, taken, shard)
        own.append((arc, taken, n))
    for turn in range(2):
        for arc, shard in enumerate(owners):
            if turn == 0 and own[arc][1] < own[arc][2]:
                waiting.append([arc, own[arc][1], own[arc][2]])
            while waiting and free[shard]:
                a, low, high = waiting[0]
                count = min(high - low, free[shard])
                place(a, low, count, shard)
                waiting[0][1] += count
                if waiting[0][1] == high:
                    waiting.popleft()
    if waiting:
        raise ValueError("the capacities are smaller than the number of rows")
    return out


def assign_shards(
    docs: DataFrame,
    shards: int = 8,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = 0.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows (key, size, text_crc32, arc, shard, slot): the shard of every row and its place in it.

    `slack` is the share of rows that a shard may hold beyond the mean; more slack moves fewer keys
    when a shard is added, no slack makes the counts equal.
    """
    spark = docs.sparkSession
    points = ring_points(shards, virtual_nodes)
    owners = [s for _, s in points] + [points[0][1]]
    cells = spark.createDataFrame(ring_cells(points), "_cell long, _low long, _high long, _arc int")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body).cast("long") + 1).alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"),
        md5_number(F.concat(F.lit("key|"), F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("_pos"),
    ).withColumn("_cell", F.shiftright("_pos", HASH_BITS - CELL_BITS))
    # The ring's table has at most 2 ** CELL_BITS + shards * virtual_nodes + 1 rows.
    keyed = keyed.join(F.broadcast(cells), "_cell").where("_pos between _low and _high").drop("_cell", "_low", "_high")

    counts = {r["_arc"]: r["n"] for r in keyed.groupBy("_arc").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    plan = stretches(counts, owners, capacities(rows, shards, slack))
    places = spark.createDataFrame(plan, "_arc int, _from long, _to long, shard int, _slot long")

    keyed = keyed.withColumn("_bucket", F.shiftright("_pos", HASH_BITS - bucket_bits(rows)))
    sizes = keyed.groupBy("_arc", "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_arc", "_bucket", before("_n", ["_arc"], ["_bucket"]).alias("_before"))
    inside = Window.partitionBy("_arc", "_bucket").orderBy("_pos", "_key", "_crc", "_size")
    placed = (
        keyed.withColumn("_in", F.row_number().over(inside) - 1)
        .join(sizes, ["_arc", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        # Each arc has one stretch for its own shard and those its overflow was cut into: the table
        # is bounded by three turns over the ring.
        .join(F.broadcast(places), "_arc")
        .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    )
    return placed.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_arc").alias("arc"),
        "shard",
        (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"),
    )
