"""Audits: tables of violations `(check, key, detail)` and tables of counts. None collects data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.loci import chr_index
from sitewise.operators.ranking import ranked


def violation(check: str, key, detail):
    return [F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column and the share, plus a line `*` with the rows that have any null."""
    flags = [F.col(c).isNull().cast("bigint") for c in columns]
    anywhere = F.greatest(*flags) if len(flags) > 1 else flags[0]
    sums = df.agg(
        F.count("*").alias("_rows"),
        *[F.sum(f).alias(f"_{i}") for i, f in enumerate(flags)],
        F.sum(anywhere).alias("_any"),
    )
    lines = [F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("nulls")) for i, c in enumerate(columns)]
    lines.append(F.struct(F.lit("*").alias("column_name"), F.col("_any").alias("nulls")))
    return (
        sums.select("_rows", F.explode(F.array(*lines)).alias("_l"))
        .select("_l.column_name", F.coalesce("_l.nulls", F.lit(0)).alias("nulls"), "_rows")
        .select("column_name", "nulls", F.try_divide(F.col("nulls"), F.col("_rows")).alias("share"))
    )


def null_map(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Null totals of rows and columns of a long matrix, most nulls first, clean rows left out."""
    each = F.explode(
        F.array(
            F.struct(F.lit("row").alias("axis"), F.col(row).alias("key")),
            F.struct(F.lit("column").alias("axis"), F.col(column).alias("key")),
        )
    )
    totals = (
        df.select(each.alias("_k"), F.col(value).isNull().cast("bigint").alias("_null"))
        .groupBy("_k.axis", "_k.key")
        .agg(F.sum("_null").alias("nulls"))
        .where("nulls > 0 or axis = 'column'")
    )
    return ranked(totals, ["axis"], [F.col("nulls").desc(), "key"], "place")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, rows beyond the first of their key, and their share."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"))
        .agg(F.sum("n").alias("num_rows"), F.count("*").alias("num_keys"))
        .select(
            "num_rows",
            "num_keys",
            (F.col("num_rows") - F.col("num_keys")).alias("num_repeats"),
            F.try_divide(F.col("num_rows") - F.col("num_keys"), F.col("num_rows")).alias("repeat_share"),
        )
    )


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, tagged by side, from one full join of the distinct keys."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    return (
        a.join(b, key, "full_outer")
        .where("_a is null or _b is null")
        .select(key, F.when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))
    )


def key_count_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose multiplicities differ: the two key lists as multisets."""
    both = (
        left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy(key)
        .agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    )
    return both.where("n_left <> n_right")


def mapping_differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Shared keys that the two tables map to different values."""
    return (
        left.select(key, F.col(value).alias("left_value"))
        .join(right.select(key, F.col(value).alias("right_value")), key)
        .where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    )


def unknown_chromosomes(df: DataFrame, chr_: str = "chr") -> DataFrame:
    return (
        df.where(chr_index(chr_).isNull())
        .groupBy(chr_)
        .agg(F.count("*").alias("_n"))
        .select(*violation("known_chromosome", F.col(chr_), F.col("_n")))
    )


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of either column that meet more than one value of the other."""
    pairs = df.select(a, b).distinct()
    left = pairs.groupBy(a).agg(F.count("*").alias("_n")).where("_n > 1")
    right = pairs.groupBy(b).agg(F.count("*").alias("_n")).where("_n > 1")
    return left.select(*violation(f"{a}_to_{b}", F.col(a), F.col("_n"))).unionByName(
        right.select(*violation(f"{b}_to_{a}", F.col(b), F.col("_n")))
    )


def split_audit(splits: DataFrame, everything: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Counts that must be zero: keys in two splits, keys in none, split keys that do not exist."""
    per_key = splits.groupBy(key).agg(F.count("*").alias("_n"), F.lit(True).alias("_s"))
    known = everything.select(key).distinct().withColumn("_e", F.lit(True))
    merged = per_key.join(known, key, "full_outer")
    counts = merged.agg(
        F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).alias("overlap"),
        F.sum(F.when(F.col("_s").isNull(), 1).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col("_e").isNull(), 1).otherwise(0)).alias("unknown"),
    )
    lines = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in ("overlap", "missing", "unknown")]
    )
    return counts.select(F.explode(lines).alias("_l")).select("_l.check", "_l.violations")


def enforce(violations: DataFrame) -> None:
    """Strict mode: raise when an audit returns any row; shows at most five of them."""
    shown = violations.limit(5).collect()
    if shown:
        raise ValueError("audit failed: " + "; ".join(str(r.asDict()) for r in shown))


def any_null(columns: list[str]):
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def null_violations(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.where(any_null(columns)).select(*violation("not_null", F.col(key), F.lit(",".join(columns))))


def product_violations(long: DataFrame, site: str, sample: str) -> DataFrame:
    """A full matrix has one row per site and sample: reports the two counts when they differ."""
    sizes = long.agg(
        F.count("*").alias("_rows"), (F.count_distinct(site) * F.count_distinct(sample)).alias("_cells")
    )
    return sizes.where("_rows <> _cells").select(*violation("full_product", F.col("_rows"), F.col("_cells")))


def total_violations(sizes: DataFrame, expected: DataFrame, key: str, rows: str) -> DataFrame:
    """Row counts per part against the expected ones, parts of one side only included."""
    merged = sizes.select(key, F.col(rows).alias("_have")).join(
        expected.select(key, F.col(rows).alias("_want")), key, "full_outer"
    )
    detail = F.format_string("%s rows, expected %s", F.col("_have"), F.col("_want"))
    return merged.where(~F.col("_have").eqNullSafe(F.col("_want"))).select(*violation("row_count", F.col(key), detail))
