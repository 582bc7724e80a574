"""Scores of predictions by site, by sample and by split."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.numeric import abs_error, both_present, safe_corr, squared_error
from sitewise.operators.ranking import exact_quantiles, join_back
from sitewise.operators.staging import write_and_read

PRED, TRUTH = "pred_methyl", "gt_methyl"


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows where prediction and truth both exist; scores never see the others."""
    return df.where(both_present(PRED, TRUTH))


def correlation_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation per key; one shuffle of partial moments, whatever the group sizes."""
    return complete_rows(df).groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(PRED, TRUTH).alias("pcc"))


def spread_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return (
        complete_rows(df)
        .groupBy(*keys)
        .agg(F.stddev_samp(PRED).alias("pred_methyl_std"), F.stddev_samp(TRUTH).alias("gt_methyl_std"))
    )


def correlation_and_spread_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation and both spreads of a key from one scan and one shuffle."""
    return (
        complete_rows(df)
        .groupBy(*keys)
        .agg(
            safe_corr(PRED, TRUTH).alias("pcc"),
            F.stddev_samp(PRED).alias("pred_methyl_std"),
            F.stddev_samp(TRUTH).alias("gt_methyl_std"),
        )
    )


def loss_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return (
        complete_rows(df)
        .groupBy(*keys)
        .agg(F.avg(squared_error(PRED, TRUTH)).alias("mse"), F.avg(abs_error(PRED, TRUTH)).alias("mae"))
    )


def loss_by_each_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Losses for each single key in one scan: rows (key_name, key, mse, mae)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).alias("key")) for k in keys]))
    return loss_by(
        complete_rows(df).select(each.alias("_k"), PRED, TRUTH).select("_k.key_name", "_k.key", PRED, TRUTH),
        ["key_name", "key"],
    )


def metric_summary(df: DataFrame, group: str = "group_idx") -> DataFrame:
    """Losses per split and mean and median of the per-site and per-sample correlations.

    The facts are read twice, once per key. The per-sample pass also carries the sums of the
    losses. Both small tables are stacked and written, and all that follows reads them.
    """
    rows = complete_rows(df)
    pcc = safe_corr(PRED, TRUTH).alias("pcc")
    by_site = rows.groupBy(group, "cpg_idx").agg(pcc)
    by_sample = rows.groupBy(group, "sample_idx").agg(
        pcc,
        F.count("*").alias("n"),
        F.sum(squared_error(PRED, TRUTH)).alias("squares"),
        F.sum(abs_error(PRED, TRUTH)).alias("absolutes"),
    )
    scores = write_and_read(
        by_site.select(group, F.lit("cpg").alias("level"), F.col("cpg_idx").alias("key"), "pcc").unionByName(
            by_sample.withColumns({"level": F.lit("sample"), "key": F.col("sample_idx")}).drop("sample_idx"),
            allowMissingColumns=True,
        ),
        "scores",
    )
    pccs = scores.where("pcc is not null").select(group, "level", "key", "pcc")
    medians = exact_quantiles(pccs, [group, "level"], "pcc", [0.5], tie=["key"])

    def per_level(stat, source: DataFrame, column: str) -> DataFrame:
        return source.groupBy(group).agg(
            *[stat(F.when(F.col("level") == level, F.col(column))).alias(f"{level}_{column}") for level in ("cpg", "sample")]
        )

    losses = scores.groupBy(group).agg(
        F.try_divide(F.sum("squares"), F.sum("n")).alias("mse_loss_per_point"),
        F.try_divide(F.sum("absolutes"), F.sum("n")).alias("mae_loss_per_point"),
    )
    return (
        losses.join(per_level(F.avg, pccs, "pcc"), group, "left")
        .join(per_level(F.max, medians, "quantile"), group, "left")
        .select(
            group,
            "mse_loss_per_point",
            "mae_loss_per_point",
            F.col("cpg_pcc").alias("pcc_by_cpg_mean"),
            F.col("sample_pcc").alias("pcc_by_sample_mean"),
            F.col("cpg_quantile").alias("pcc_by_cpg_median"),
            F.col("sample_quantile").alias("pcc_by_sample_median"),
        )
    )


def group_sizes_equal(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key column: number of groups, smallest and largest group, and whether all agree."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).alias("key")) for k in keys]))
    sizes = df.select(each.alias("_k")).groupBy("_k.key_name", "_k.key").agg(F.count("*").alias("n"))
    return sizes.groupBy("key_name").agg(
        F.count("*").alias("num_groups"),
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        (F.min("n") == F.max("n")).alias("all_equal"),
    )


def share_at_least(df: DataFrame, value: str, marks: list[float], keys: list[str]) -> DataFrame:
    """Share of the non-null values at or above each mark."""
    marked = df.where(F.col(value).isNotNull()).select(
        *keys, value, F.explode(F.array(*[F.lit(float(m)) for m in marks])).alias("mark")
    )
    return marked.groupBy(*keys, "mark").agg(
        F.avg(F.when(F.col(value) >= F.col("mark"), 1.0).otherwise(0.0)).alias("share")
    )


def letter_values(df: DataFrame, keys: list[str], value: str, probs: list[float], tie: list[str]) -> DataFrame:
    """Quantile table behind box and boxen plots."""
    return exact_quantiles(df, keys, value, probs, tie).select(*keys, "n", "q", "quantile")


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins on [low, high]; the last bin is closed."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    bin_no = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return inside.groupBy(*keys, bin_no.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, keys: list[str], value: str, points: int = 100, cut: float = 2.0) -> DataFrame:
    """Kernel density of each group at `points` places from `cut` bandwidths below to as many above its values.

    Gaussian kernel, bandwidth sample deviation times n ** (-1/5). Each value is shared out between the two
    places next to it, weighted by nearness, so a group is `points` sums before the shuffle, however many
    values it has; the sums are then convolved with the kernel. Groups without two different values have
    no density.
    """
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    facts = values.groupBy(*keys).agg(
        F.count("*").alias("n"), F.stddev_samp("_v").alias("_s"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    width = F.col("_s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    facts = facts.where("_min < _max").withColumn("bandwidth", width)
    facts = facts.withColumn("_low", F.col("_min") - F.lit(cut) * F.col("bandwidth")).withColumn(
        "_step", (F.col("_max") - F.col("_min") + F.lit(2.0 * cut) * F.col("bandwidth")) / F.lit(points - 1)
    )
    facts = facts.select(*keys, "n", "bandwidth", "_low", "_step")
    at = (F.col("_v") - F.col("_low")) / F.col("_step")
    left = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    ends = F.array(
        F.struct(left.alias("i"), (F.lit(1.0) - (at - left)).alias("w")), F.struct((left + 1).alias("i"), (at - left).alias("w"))
    )
    shared = join_back(values, facts, keys).select(*keys, F.explode(ends).alias("_e"))
    sums = shared.groupBy(*keys, "_e.i").agg(F.sum("_e.w").alias("w"))
    grid = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("_g"))

    def at_point(k: Column) -> Column:
        far = lambda e: (k - e["i"]) * F.col("_step") / F.col("bandwidth")
        return F.aggregate("_g", F.lit(0.0), lambda acc, e: acc + e["w"] * F.exp(F.lit(-0.5) * far(e) * far(e)))

    made = join_back(grid, facts, keys).select(
        *keys, "n", "bandwidth", "_low", "_step", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at_point)).alias("point", "_sum")
    )
    scale = F.col("n") * F.col("bandwidth") * F.lit((2 * math.pi) ** 0.5)
    return made.select(
        *keys, "n", "bandwidth", "point", (F.col("_low") + F.col("point") * F.col("_step")).alias("x"), (F.col("_sum") / scale).alias("density")
    )


def metrics_wide(long: DataFrame, index: str, names: list[str]) -> DataFrame:
    """One row per index and one column per named metric, from (index, metric, value) rows."""
    return long.groupBy(index).pivot("metric", names).agg(F.first("value"))


def side_by_side(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row per key and one column per named table; a key may be missing from any of them."""
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [f.select(key, F.lit(n).alias("metric"), F.col(value).alias("value")) for n, f in frames.items()],
    )
    return metrics_wide(stacked, key, list(frames))
