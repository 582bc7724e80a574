"""Do two shard sets hold the same rows in the same order, and where do they part?

A row has a place: the rows of the shards before its own plus its number in its file. Row numbers come
from the parquet reader, so nothing is sorted. The digest of an ordered set is a polynomial of its row
numbers in `BASE` modulo a prime; blocks of places are added up where the rows are read and blocks of
blocks after that, so sets that were cut into shards of other sizes still agree block by block, and only
the first block that differs is compared row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIME = (1 << 31) - 1
BASE = 1_000_003
BLOCK = 4096
_SIDE = 64  # BLOCK is _SIDE squared: a power is the product of two looked-up ones


def shard_rows(spark: SparkSession, path: str, keys: list[str], shard: str | None = None) -> DataFrame:
    """(pos, keys): every row with its place in the set, shards in the order of column `shard` or of their names."""
    rows = spark.read.parquet(path)
    by = [F.col(shard).alias("_shard")] if shard else []
    rows = rows.select(*keys, *by, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    order = (["_shard"] if shard else []) + ["_file"]
    # One row per shard file.
    sizes = rows.groupBy(*order).agg((F.max("_row") + 1).alias("_n"))
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "_file").select((F.col("_offset") + F.col("_row")).alias("pos"), *keys)


def row_number_of(keys: list[str]) -> Column:
    """The keys of a row as a number of 60 bits; null differs from every text."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _power(exponent: Column, base: int) -> Column:
    """base ** exponent modulo the prime, for exponents below `BLOCK`."""
    low = F.array(*[F.lit(pow(base, i, PRIME)).cast("bigint") for i in range(_SIDE)])
    high = F.array(*[F.lit(pow(base, i * _SIDE, PRIME)).cast("bigint") for i in range(_SIDE)])
    return low[(exponent % _SIDE).cast("int")] * high[F.floor(exponent / _SIDE).cast("int")] % PRIME


def block_digests(rows: DataFrame, level: int = 0) -> DataFrame:
    """(pos, h, n) of each block of `BLOCK` places out of rows (pos, h); `level` counts the blocks of blocks."""
    base = pow(BASE, BLOCK**level, PRIME)
    term = F.col("h") % PRIME * _power(F.col("pos") % BLOCK, base) % PRIME
    n = F.sum("n") if level else F.count("*")
    blocks = rows.groupBy(F.floor(F.col("pos") / BLOCK).alias("block")).agg((F.sum(term) % PRIME).alias("h"), n.alias("n"))
    return blocks.withColumnRenamed("block", "pos")


def order_digest(blocks: DataFrame) -> DataFrame:
    """(digest, n) of a whole set out of its blocks, by levels of `BLOCK` blocks."""
    last = blocks.agg(F.max("pos")).first()[0] or 0
    level = 1
    while last:
        blocks, last, level = block_digests(blocks, level), last // BLOCK, level + 1
    return blocks.agg(F.coalesce(F.max("h"), F.lit(0)).alias("digest"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def compare_order(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sizes and digests of both sets, whether rows and order agree, and the first place that differs.

    Sets are (pos, keys) as `shard_rows` gives them. `same_rows` compares the sets without order, by the
    sums of two numbers of each row. A place that only one set has counts as different.
    """
    numbered = [s.select("pos", row_number_of(keys).alias("h")) for s in (left, right)]
    blocks = [block_digests(s) for s in numbered]
    sums = [
        s.agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("b"))
        for s in numbered
    ]
    digests = [order_digest(b) for b in blocks]

    def meet(pair: list[DataFrame], on: str, values: list[str]) -> DataFrame:
        sides = [s.select(on, *[F.col(v).alias(f"{v}_{i}") for v in values]) for i, s in enumerate(pair)]
        differs = [~F.col(f"{v}_0").eqNullSafe(F.col(f"{v}_1")) for v in values]
        both = sides[0].join(sides[1], on, "full_outer")
        return both.where(differs[0] if len(differs) == 1 else differs[0] | differs[1])

    first_block = meet(blocks, "pos", ["h", "n"]).agg(F.min("pos").alias("block"))
    inside = [
        s.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(first_block, "block", "left_semi").select("pos", "h")
        for s in numbered
    ]
    first = meet(inside, "pos", ["h"]).agg(F.min("pos").alias("first_difference"))
    parts = [
        *[d.select(F.lit(1).alias("_one"), F.col("n").alias(f"n_{side}"), F.col("digest").alias(f"digest_{side}")) for d, side in zip(digests, ("left", "right"))],
        *[s.select(F.lit(1).alias("_one"), F.struct("a", "b").alias(f"sum_{side}")) for s, side in zip(sums, ("left", "right"))],
        first.withColumn("_one", F.lit(1)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(part, "_one")
    return whole.select(
        "n_left", "n_right", "digest_left", "digest_right",
        (F.col("sum_left").eqNullSafe(F.col("sum_right")) & (F.col("n_left") == F.col("n_right"))).alias("same_rows"),
        F.col("first_difference").isNull().alias("same_order"), "first_difference",
    )
