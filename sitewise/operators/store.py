"""Tables kept by the hash of their key, for joins that move only the other side.

A site table is joined again and again: windows with islands, pairs with sites, every export of a cohort.
Written bucketed and sorted by its key it is already where a join wants it, so the join exchanges the pairs
alone, and two bucketed tables meet without any exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sitewise.operators.staging import staging_path


def write_bucketed(df: DataFrame, key: str, buckets: int | None = None, label: str = "store") -> DataFrame:
    """Write `df` bucketed and sorted by `key` and read it as a table.

    Without `buckets` there are as many as shuffle partitions, so that the other side of a join is dealt to
    as many tasks as any shuffle would use. Rows meet their bucket before the write: one file per bucket.
    The files lie in the shared staging folder; the session's catalogue holds the table's name only.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet")
    writer.option("path", staging_path(spark, label)).saveAsTable(name)
    return spark.table(name)
