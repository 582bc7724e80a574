"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators.staging import write_and_read


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of the edges (u, v).

    Large-star and small-star steps in turn: each node hands its neighbours to its smallest one, until
    every edge leads to a root. Minima are taken before the shuffle, so a node with many neighbours is
    one row of it; the join back is split by Spark where a node is hot. Each round writes its edges.
    """
    smaller = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    smaller = write_and_read(smaller, "edges")
    state = _state(smaller)
    while state[0]:
        both = smaller.unionByName(smaller.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = write_and_read(large.distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smaller = write_and_read(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, state = state, _state(smaller)
        if last == state:
            break
    roots = smaller.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(smaller.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
