"""Positions and exact quantiles without a window that holds a whole group.

`row_number()` over a hot key sorts that key in one task. The two rankings below spread
any key over many tasks: `ranked` by sorted ranges, `hash_ranked` by hash prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.functions.numeric import col
from sitewise.operators.staging import write_and_read

_LOCAL_ROW = (1 << 33) - 1  # low bits of monotonically_increasing_id


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_back(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on keys that may be null, keeping one copy of the keys."""
    renamed = side.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return df.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """0-based position of each row inside its key, `order` being a total order.

    Rows are range-partitioned and sorted once, and written with their partition number and
    local row number. A prefix sum over the partition sizes (one row per partition) turns the
    local numbers into global ones; the first number of a key is then taken off.
    """
    sort = [F.col(k) for k in keys] + [col(o) for o in order]
    staged = write_and_read(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_ROW))),
        "ranked",
    )
    offsets = (
        staged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
        )
    )
    placed = staged.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_row"))
    placed = placed.drop("_row", "_offset")
    if not keys:
        return placed.drop("_part")
    # One row per key and part; joining on both keeps a key with many rows split as the parts split it.
    starts = (
        staged.groupBy(*keys, "_part")
        .agg(F.min("_row").alias("_row"))
        .join(offsets, "_part")
        .select(*keys, "_part", F.min(F.col("_offset") + F.col("_row")).over(Window.partitionBy(*keys)).alias("_first"))
    )
    placed = join_back(placed, starts, [*keys, "_part"])
    return placed.withColumn(name, F.col(name) - F.col("_first")).drop("_first", "_part")


def hash_text(ids: list[str], seed: int) -> Column:
    """Portable pseudo-random order: the md5 text of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


#: Rows that one hash bucket should hold.
BUCKET_ROWS = 100_000


def hash_ranked(
    df: DataFrame,
    keys: list[str],
    ids: list[str],
    seed: int,
    name: str = "rank",
    total: str | None = None,
    below: int | None = None,
) -> DataFrame:
    """0-based position inside the key in hash order; `ids` must identify a row inside its key.

    A key is cut into even buckets by the leading hash digits, as many as the number of rows asks
    for. The position is the size of the earlier buckets plus the position inside the own bucket, so
    no task sees more than one bucket of a key. With `below` only rows at smaller positions are
    returned, and buckets that start beyond it are left out before they are sorted.
    """
    # Written once: counting, bucket sizes and ranks below read the file, not the plan behind `df`.
    hashed = write_and_read(df.withColumn("_hash", hash_text(ids, seed)), "hashed")
    digits = 1
    rows = hashed.count()
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    per_key = Window.partitionBy(*keys)
    buckets = (
        hashed.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(per_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("_total", F.sum("_n").over(per_key))
        .drop("_n")
    )
    if below is not None:
        buckets = buckets.where(F.col("_before") < below)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_hash", *ids)
    out = join_back(hashed, buckets, [*keys, "_bucket"]).withColumn("_inside", F.row_number().over(inside) - 1)
    out = out.withColumn(name, F.col("_before") + F.col("_inside"))
    if below is not None:
        out = out.where(F.col(name) < below)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_hash", "_bucket", "_before", "_total", "_inside")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], tie: list[str] | None = None
) -> DataFrame:
    """Rows (keys, n, q_no, q, quantile) with linear interpolation, nulls left out.

    The values are placed by `ranked` and the rows at the wanted positions are read, at any size.
    `tie` names columns that tell equal values apart, so that a value shared by many rows is split
    as well.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, *(tie or []))
    return _quantiles_by_position(ranked(rows, keys, [value, *(tie or [])], "_pos"), keys, value, probs)


def _quantiles_by_position(placed: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("q_no"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])
    )
    targets = (
        placed.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .where("n > 0")
        .select(*keys, "n", wanted.alias("_w"))
        .select(*keys, "n", "_w.q_no", "_w.q", ((F.col("n") - 1) * F.col("_w.q")).alias("_h"))
        .withColumn("_low", F.floor("_h"))
        .withColumn("_high", F.least(F.col("_low") + 1, F.col("n") - 1))
        .withColumn("_pos", F.explode(F.array_distinct(F.array("_low", "_high"))))
    )
    hits = join_back(targets, placed.select(*keys, "_pos", value), [*keys, "_pos"])
    ends = hits.groupBy(*keys, "n", "q_no", "q", "_h", "_low").agg(
        F.max(F.when(F.col("_pos") == F.col("_low"), F.col(value))).alias("_a"),
        F.max(F.when(F.col("_pos") == F.col("_high"), F.col(value))).alias("_b"),
    )
    return ends.select(
        *keys,
        "n",
        "q_no",
        "q",
        (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_low"))).alias("quantile"),
    )
