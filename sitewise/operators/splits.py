"""Train and validation splits in hash order.

A random generator's order cannot be repeated on a cluster; rank by the hash of seed and key
gives the same counts, and the same result for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.numeric import floor_share, half_even_share
from sitewise.operators.layout import dealt
from sitewise.operators.ranking import hash_ranked


def split_sites(
    sites: DataFrame, val_share: float, train_share: float, seed: int, by: str = "chr", key: str = "chr_pos"
) -> DataFrame:
    """Per chromosome: validation first, then train, the rest `unused`; shares are truncated."""
    if val_share + train_share > 1:
        raise ValueError("the shares add up to more than 1")
    placed = hash_ranked(sites, [by], [key], seed, "_rank", "_size")
    val_end = floor_share("_size", val_share)
    train_end = val_end + floor_share("_size", train_share)
    return placed.withColumn(
        "split",
        F.when(F.col("_rank") < val_end, "val").when(F.col("_rank") < train_end, "train").otherwise("unused"),
    ).drop("_rank", "_size")


def split_samples(samples: DataFrame, train_share: float, seed: int, by: str = "tissue_name", key: str = "sample_name"):
    """Inside each tissue: the rounded share goes to train; a single sample always does."""
    if not 0 < train_share <= 1:
        raise ValueError("train share must be in (0, 1]")
    placed = hash_ranked(samples, [by], [key], seed, "_rank", "_size")
    train = (F.col("_size") == 1) | (F.col("_rank") < half_even_share("_size", train_share))
    return placed.withColumn("split", F.when(train, "train").otherwise("val")).drop("_rank", "_size")


def hold_out_tissues(samples: DataFrame, n: int, seed: int, by: str = "tissue_name") -> DataFrame:
    """n whole tissues, among those with one sample, go to validation."""
    single = samples.groupBy(by).agg(F.count("*").alias("_n")).where("_n = 1").select(by)
    held = hash_ranked(single, [], [by], seed, "_rank").where(F.col("_rank") < n)
    return samples.join(held.select(by, F.lit(True).alias("_held")), by, "left").select(
        *samples.columns, F.when(F.col("_held"), "val").otherwise("train").alias("split")
    )


def four_way(pairs: DataFrame, sites: DataFrame, samples: DataFrame, tasks: int | None = None) -> DataFrame:
    """Label each (site, sample) pair with its split name; pairs of unused sites go.

    Sites come first: pairs dealt by site do not move for them and those of unused sites never move at all.
    With `tasks` both joins deal the pairs to that many, whatever is broadcast.
    """
    site_part = sites.where("split in ('train', 'val')").select("cpg_idx", F.col("split").alias("_site"))
    sample_part = samples.where("split in ('train', 'val')").select("sample_idx", F.col("split").alias("_sample"))
    return (
        pairs.join(dealt(site_part, "cpg_idx", tasks), "cpg_idx")
        .join(dealt(sample_part, "sample_idx", tasks), "sample_idx")
        .withColumn(
            "split",
            F.concat(F.col("_site"), F.lit("_cpg-"), F.col("_sample"), F.lit("_sample")),
        )
        .drop("_site", "_sample")
    )


def random_subset(df: DataFrame, n: int, ids: list[str], seed: int) -> DataFrame:
    """n rows without replacement, at any n: the first in hash order; only buckets below n are sorted."""
    return hash_ranked(df, [], ids, seed, "_rank", below=n).drop("_rank")


def shuffle_positions(df: DataFrame, ids: list[str], seed: int, name: str = "place") -> DataFrame:
    """Position of each row in a global shuffle."""
    return hash_ranked(df, [], ids, seed, name)
