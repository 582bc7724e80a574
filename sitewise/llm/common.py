"""Pieces shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.operators.staging import write_and_read

#: A word: a run of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one window task should hold.
ROWS_PER_BUCKET = 200_000
HASH_BITS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_number(text: Column) -> Column:
    """The first 60 bits of the md5 of a text as a long; portable between engines."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_bits(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Leading hash bits that cut `rows` evenly spread rows into buckets of the wanted size."""
    return max(0, min(HASH_BITS, (max(1, -(-rows // rows_per_bucket)) - 1).bit_length()))


def before(value: str, partition: list[str], order: list[str]) -> Column:
    """Sum of `value` over the earlier rows of the window, 0 for the first."""
    window = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return F.coalesce(
        F.sum(value).over(window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).cast("long")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on keys that may be null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learnable: Column, most: dict[int, int]
) -> DataFrame:
    """Rows (text, label) with different texts, at most `most[value]` rows of each label, by hash of the id."""
    given = labels.where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    given = given.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.md5(F.col("doc_id").cast("string"))
    picks = [given.where(F.col("label") == v).orderBy(order, "doc_id").limit(n) for v, n in most.items()]
    picked = picks[0]
    for p in picks[1:]:
        picked = picked.unionByName(p)
    # The picked ids are bounded by `most`.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")
    return write_and_read(rows.groupBy("text").agg(F.max("label").alias("label")), "labelled")
