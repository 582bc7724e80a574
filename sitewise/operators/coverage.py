"""Base coverage of two splits by an interval sweep on tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chr_max(sites: DataFrame, chr_: str = "chr", pos: str = "pos") -> DataFrame:
    return sites.groupBy(chr_).agg(F.max(pos).alias("max_pos"))


def tile_events(sites: DataFrame, limits: DataFrame, bases: int, width: int) -> DataFrame:
    """+1 / -1 events (chr, tile, at, split, step) of the intervals `[pos, min(max_pos, pos + bases))`.

    An interval is clipped to each tile it meets, so a tile is complete in itself.
    """
    spans = (
        sites.join(limits, "chr")
        .select(
            "chr",
            "split",
            F.col("pos").alias("_a"),
            F.least(F.col("max_pos"), F.col("pos") + F.lit(2 * (bases // 2))).alias("_b"),
        )
        .where("_b > _a")
    )
    first, last = F.floor(F.col("_a") / F.lit(width)), F.floor((F.col("_b") - 1) / F.lit(width))
    per_tile = spans.withColumn("tile", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("_a"), F.col("tile") * F.lit(width))
    end = F.least(F.col("_b"), (F.col("tile") + 1) * F.lit(width))
    events = F.explode(
        F.array(F.struct(begin.alias("at"), F.lit(1).alias("step")), F.struct(end.alias("at"), F.lit(-1).alias("step")))
    )
    return per_tile.select("chr", "tile", "split", events.alias("_e")).select("chr", "tile", "split", "_e.at", "_e.step")


def split_overlap(sites: DataFrame, bases: int, width: int = 65536) -> DataFrame:
    """Per chromosome: bases covered by both splits, by either, and the two ratios.

    `sites` has (chr, pos, split) with split `train` or `val`. Events are summed per position
    before the sweep, so a tile holds at most `width + 1` of them however often a site repeats.
    """
    limits = chr_max(sites)
    steps = (
        tile_events(sites, limits, bases, width)
        .groupBy("chr", "tile", "at")
        .agg(
            F.sum(F.when(F.col("split") == "train", F.col("step")).otherwise(0)).alias("_t"),
            F.sum(F.when(F.col("split") == "val", F.col("step")).otherwise(0)).alias("_v"),
        )
    )
    sweep = Window.partitionBy("chr", "tile").orderBy("at")
    running = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = steps.select(
        "chr",
        F.sum("_t").over(running).alias("_train"),
        F.sum("_v").over(running).alias("_val"),
        (F.lead("at").over(sweep) - F.col("at")).alias("_len"),
    )
    sums = segments.groupBy("chr").agg(
        F.sum(F.when((F.col("_train") > 0) & (F.col("_val") > 0), F.col("_len")).otherwise(0)).alias("num_overlap"),
        F.sum(F.when((F.col("_train") > 0) | (F.col("_val") > 0), F.col("_len")).otherwise(0)).alias("num_used"),
    )
    return (
        limits.join(sums, "chr", "left")
        .select(
            "chr",
            F.coalesce("num_overlap", F.lit(0)).alias("num_overlap"),
            (F.col("max_pos") + F.lit(bases)).alias("num_bases"),
            F.coalesce("num_used", F.lit(0)).alias("num_used"),
        )
        .withColumn("ratio_all", F.try_divide(F.col("num_overlap"), F.col("num_bases")))
        .withColumn("ratio_used", F.try_divide(F.col("num_overlap"), F.col("num_used")))
    )
