"""Writers. Each writes from the tasks that hold the data; none gathers it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators.reshape import assign_shards, interleave

MODES = {"overwrite": "overwrite", "skip": "ignore", "fail": "errorifexists"}


def write_shards(df: DataFrame, path: str, rows_per_file: int, mode: str = "fail", partitions: int | None = None):
    """Parquet files of at most `rows_per_file` rows."""
    out = df if partitions is None else df.repartition(partitions)
    out.write.mode(MODES[mode]).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_equal_shards(df: DataFrame, path: str, order: list[str], rows_per_file: int, mode: str = "fail"):
    """Files of exactly `rows_per_file` rows in the given order, the last with the rest.

    Rows get the number of their shard, and a shard is written by one task as `shard=<number>`. The task
    sorts it once more, as the rows of a shard may come out of several tasks in any order.
    """
    placed = assign_shards(df, order, rows_per_file, place="_place").repartition("shard")
    placed = placed.sortWithinPartitions("shard", "_place").drop("_place")
    placed.write.mode(MODES[mode]).partitionBy("shard").parquet(path)


def write_split_dataset(df: DataFrame, path: str, by: list[str], rows_per_file: int = 1_000_000, mode: str = "fail"):
    """All splits in one job, one directory per value of `by`.

    Rows are not gathered per split: each task writes its own file to each directory, so a split
    that holds most of the data is written by all tasks.
    """
    df.write.mode(MODES[mode]).option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def write_shuffled(df: DataFrame, path: str, order, partitions: int, by: list[str] | None = None, mode: str = "fail"):
    """Rows spread over the files by a hash and sorted by it inside each file: a global shuffle."""
    mixed = df.withColumn("_order", order).repartition(partitions, "_order").sortWithinPartitions("_order").drop("_order")
    writer = mixed.write.mode(MODES[mode])
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_sorted_by_id(df: DataFrame, path: str, idx: str, mode: str = "fail"):
    """Range-partitioned and sorted by id, so a lookup reads one row group."""
    df.repartitionByRange(idx).sortWithinPartitions(idx).write.mode(MODES[mode]).parquet(path)


def write_lookup(df: DataFrame, path: str, idx: str, names: list[str] = [], rows_per_group: int = 100_000, mode: str = "fail"):
    """A table for point lookups by `idx` or by one of `names`.

    Files are range-partitioned and sorted by `idx`, so the statistics of row groups and pages rule out all
    but the place of an id. The names lie in no order; each row group gets a Bloom filter for them.
    """
    writer = df.repartitionByRange(idx).sortWithinPartitions(idx).write.mode(MODES[mode])
    writer = writer.option("parquet.block.row.count.limit", rows_per_group).option("parquet.page.row.count.limit", 20_000)
    for name in names:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", rows_per_group)
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(path)


def write_interleaved(df: DataFrame, path: str, source: str, order: list[str], batch: int, rows_per_file: int, mode: str = "fail"):
    """Files of exactly `rows_per_file` rows in which the sources take turns, see `reshape.interleave`."""
    if rows_per_file % batch:
        raise ValueError(f"{rows_per_file} rows a file are no multiple of {batch} rows a batch")
    placed = interleave(df, source, order, batch).withColumn("shard", F.floor(F.col("place") / F.lit(rows_per_file)))
    dealt = placed.repartition("shard").sortWithinPartitions("shard", "place").drop("place")
    dealt.write.mode(MODES[mode]).partitionBy("shard").parquet(path)


def write_summary(df: DataFrame, path: str, form: str = "csv", mode: str = "fail"):
    """Small result tables as CSV, TSV or JSON."""
    writer = df.write.mode(MODES[mode])
    if form == "json":
        writer.json(path)
    elif form in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def markdown(df: DataFrame, max_rows: int = 10_000) -> str:
    """A report table as markdown text; refuses a table that is no report."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for r in rows:
        lines.append("| " + " | ".join("" if v is None else f"{v:,}" if isinstance(v, int | float) else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"


def write_tracks(lines: DataFrame, path: str, mode: str = "fail"):
    """Track text per tissue, split by chromosome and sorted by position inside each file."""
    by_place = lines.repartitionByRange("tissue_name", "chr", "pos").sortWithinPartitions("tissue_name", "chr", "pos")
    by_place.select("tissue_name", "line").write.mode(MODES[mode]).partitionBy("tissue_name").text(path)


def write_violations(violations: DataFrame, path: str, mode: str = "overwrite"):
    """Violation report; an empty report is written as an empty table."""
    violations.write.mode(MODES[mode]).option("header", True).csv(path)


def with_null_flag(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("is_null", F.col(value).isNull())


def write_null_twins(df: DataFrame, path: str, value: str, mode: str = "fail"):
    """Rows with and without a value in two directories, in one pass and in fixed memory."""
    write_split_dataset(with_null_flag(df, value), path, ["is_null"], mode=mode)
