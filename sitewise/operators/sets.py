"""Unions with source tags, first-wins dedupe, key pools, shared and exclusive parts.

Dedupe is written as an aggregate: each map task reduces a hot key to one row before the
shuffle, where a `row_number()` window would sort all copies of the key in one task.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.numeric import close_to, nan_to_null
from sitewise.operators.ranking import ranked
from sitewise.schemas import SOURCE_COMBINATIONS


def tag_sources(frames: Iterable[DataFrame], name: str = "group_idx") -> DataFrame:
    """Stack the sources, each tagged with its list position."""
    tagged = [f.withColumn(name, F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last by `order`."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(packed, F.struct(*order)).alias("_row")
    fields = [F.col(f"_row.{c}").alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(row).select(*keys, *fields).select(*df.columns)


def drop_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key occurs once; all rows of a repeated key go."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in rest])
        .where("_n = 1")
        .select(*df.columns)
    )


def union_sites(frames: Iterable[DataFrame]) -> DataFrame:
    """Union of site tables, first source wins, ids by lexicographic locus key."""
    merged = dedupe(tag_sources(frames), ["chr_pos"], ["group_idx", "cpg_idx"])
    return ranked(merged.drop("cpg_idx"), [], ["chr_pos"], "cpg_idx")


def source_combinations(tagged: DataFrame, key: str, source: str = "group_idx") -> DataFrame:
    """For keys held by more than one row: the sorted set of sources, or `other`."""
    combo = F.array_join(F.transform(F.array_sort(F.collect_set(source)), lambda s: s.cast("string")), "+")
    return (
        tagged.groupBy(key)
        .agg(F.count("*").alias("_n"), combo.alias("_combo"))
        .where("_n > 1")
        .select(
            key, F.when(F.col("_combo").isin(SOURCE_COMBINATIONS), F.col("_combo")).otherwise("other").alias("combo")
        )
    )


def key_pool(everything: DataFrame, include: list[DataFrame], exclude: list[DataFrame], key: str, start: str):
    """Rows selected by key lists: start from `all` or `null`, add lists, then take lists off."""
    if start not in ("all", "null"):
        raise ValueError(f"start must be 'all' or 'null', not {start!r}")
    if start == "all":
        kept = everything
    elif include:
        added = reduce(lambda a, b: a.union(b), [f.select(key) for f in include]).distinct()
        kept = everything.join(added, key, "left_semi")
    else:
        kept = everything.where(F.lit(False))
    for f in exclude:
        kept = kept.join(f.select(key), key, "left_anti")
    return kept


def not_subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    return part.select(key).distinct().join(whole.select(key), key, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def joint_and_rest(df: DataFrame, other: DataFrame, on: str, flag: str = "joint") -> DataFrame:
    """All rows, flagged by whether the other table has their key."""
    present = other.select(on).distinct().withColumn("_hit", F.lit(True))
    return df.join(present, on, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def suffix_repeats(df: DataFrame, name: str, order: list[str], suffix: str = "_sample") -> DataFrame:
    """Second and later rows of a name get `_sample2`, `_sample3`, …"""
    placed = ranked(df, [name], order, "_place")
    return placed.withColumn(
        "unique_name",
        F.when(F.col("_place") == 0, F.col(name)).otherwise(
            F.concat(F.col(name), F.lit(suffix), (F.col("_place") + 1).cast("string"))
        ),
    ).drop("_place")


def merge_matrices(
    tagged: DataFrame, row: str, sample: str, value: str, sources: int, source: str = "group_idx"
) -> DataFrame:
    """One value per (row, sample), first source wins; `agrees` tells whether all sources are close.

    The number of sources is known, so one aggregate keeps the smallest and largest value of each
    source in a cell; nothing is joined back. A source that repeats a cell gives its smallest value.
    """
    cell = nan_to_null(F.col(value))
    of = [F.when(F.col(source) == i, cell) for i in range(sources)]
    merged = tagged.groupBy(row, sample).agg(
        F.min(source).alias(source),
        F.count("*").alias("num_sources"),
        F.count(cell).alias("_known"),
        *[F.min(v).alias(f"_low{i}") for i, v in enumerate(of)],
        *[F.max(v).alias(f"_high{i}") for i, v in enumerate(of)],
    )
    first = F.coalesce(*[F.when(F.col(source) == i, F.col(f"_low{i}")) for i in range(sources)])
    merged = merged.withColumn("_first", first)
    near = F.col("_known") == F.col("num_sources")
    for i in range(sources):
        both = close_to("_first", f"_low{i}") & close_to("_first", f"_high{i}")
        near = near & (F.col(f"_low{i}").isNull() | both)
    return merged.select(
        row, sample, F.col("_first").alias(value), source, "num_sources", ((F.col("num_sources") == 1) | near).alias("agrees")
    )


def frame_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Largest absolute difference per column over shared keys, and the size of both unshared parts."""
    a = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_a"))
    b = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_b"))
    diffs = a.join(b, keys, "full_outer").agg(
        *[F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(c) for c in columns],
        F.count(F.when(F.col("_b").isNull(), 1)).alias("_left_only"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("_right_only"),
    )
    lines = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("max_diff")) for c in columns])
    return diffs.select(F.explode(lines).alias("_l"), "_left_only", "_right_only").select(
        "_l.column_name",
        "_l.max_diff",
        F.col("_left_only").alias("left_only"),
        F.col("_right_only").alias("right_only"),
    )


def rows_above_difference(left: DataFrame, right: DataFrame, keys: list[str], column: str, limit: float) -> DataFrame:
    joined = left.select(*keys, F.col(column).alias("left_value")).join(
        right.select(*keys, F.col(column).alias("right_value")), keys
    )
    return joined.withColumn("diff", F.abs(F.col("left_value") - F.col("right_value"))).where(
        F.col("diff") > F.lit(limit)
    )
