"""Resumable flows over growing folders of shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state on local disk with change logs, so it may outgrow executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def read_shards(
    spark: SparkSession, path: str, schema, files_per_trigger: int = 1000, glob: str | None = None
) -> DataFrame:
    """Shards in arrival order; the checkpoint of the query is the resume state."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append result files until the shards at hand are used up; a restart continues after the last batch."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def drop_repeats(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row of each key. With an event time the state is dropped after the delay; without one
    every key is remembered, on disk if `use_disk_state` was called."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def running_table(aggregated: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed keys of a streaming aggregate, one folder per batch.

    A batch that is run again replaces its own folder, so the table stays exact after a crash.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        aggregated.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row of each key of a running table."""
    table = spark.read.parquet(path)
    values = [c for c in table.columns if c not in keys and c != "batch"]
    row = F.max_by(F.struct(*values), F.col("batch")).alias("_row")
    return table.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])


def transform(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless steps, the same functions as in batch jobs."""
    for step in steps:
        stream = step(stream)
    return stream


def progress_rates(query: StreamingQuery) -> list[dict]:
    """Rows per second of the last batches."""
    return [
        {"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"]}
        for p in query.recentProgress
    ]
