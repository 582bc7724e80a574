"""Structured Streaming over the given tables: each run drains the files at hand and reads the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions.loci import chr_index
from sitewise.functions.numeric import safe_corr, value_bin
from sitewise.operators.reshape import assign_shards
from sitewise.operators.staging import staging_path
from sitewise.plans.book import query, r6, rs, sql
from sitewise.plans.inputs import corr_sql, locus, table
from sitewise.plans.keys import _CHR_IDX
from sitewise.sources.writers import write_equal_shards
from sitewise.streaming import epochs, flows
from sitewise.streaming.moments import MomentTable, scores


_SHARDS = 12


def _stream(spark, d, name: str):
    """One table as a stream of shards, be it a single file or a folder of files."""
    either = f"{d}/{name}.parque[t]"  # a pattern, as a stream takes no plain file name
    return flows.read_shards(spark, either, table(spark, d, name).schema)


def _drain(spark, stream):
    """Append the stream to a new table in the shared folder and read the table."""
    out, state = staging_path(spark, "stream"), staging_path(spark, "state")
    flows.append(stream, out, state).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_ingest", "select event_id, user_id, event_type, value from events")
def stream_ingest(spark, d):
    return _drain(spark, _stream(spark, d, "events").select("event_id", "user_id", "event_type", "value"))


@query(
    "stream_encode",
    sql(
        "locus",
        f"""select l_orderkey, l_linenumber, l_partkey, cast(round_even(l_discount * 10 * 100, 0) as bigint) as bin, chr_idx
            from lineitem left join (select cpg_idx, {_CHR_IDX} as chr_idx from locus) on l_partkey = cpg_idx""",
    ),
)
def stream_encode(spark, d):
    """The batch functions on a stream, with the site table joined as it stands."""
    sites = locus(spark, d).select(F.col("cpg_idx").alias("l_partkey"), chr_index("chr").alias("chr_idx"))
    encoded = flows.transform(
        _stream(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"),
        lambda s: s.withColumn("bin", value_bin(F.col("l_discount") * 10, 101)).drop("l_discount"),
        lambda s: s.join(sites, "l_partkey", "left"),
    )
    return _drain(spark, encoded)


@query("stream_dedupe", "select distinct l_partkey, l_suppkey from lineitem")
def stream_dedupe(spark, d):
    flows.use_disk_state(spark)
    pairs = _stream(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return _drain(spark, flows.drop_repeats(pairs, ["l_partkey", "l_suppkey"]))


@query("stream_dedupe_timed", "select user_id, event_type, event_id from events")
def stream_dedupe_timed(spark, d):
    """Shards in order of time, each with the last rows of the one before again; keys are forgotten after an hour."""
    flows.use_disk_state(spark)
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    size = -(-events.count() // _SHARDS) or 1
    placed = assign_shards(events, ["ts", "event_id"], size)
    border = placed.groupBy("shard").agg(F.max("ts").alias("_last"))
    again = placed.join(border, "shard").where(F.col("ts") >= F.col("_last") - F.expr("interval 30 minutes")).drop("_last")
    path = staging_path(spark, "padded")
    whole = placed.unionByName(again.withColumn("shard", F.col("shard") + 1))
    whole.repartition("shard").sortWithinPartitions("shard", "ts").write.partitionBy("shard").parquet(path)
    out, state = staging_path(spark, "stream"), staging_path(spark, "state")
    columns = "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz"
    stream = epochs.read_epochs(spark, path, state, columns, shards_per_batch=4)
    timed = stream.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    run = epochs.append_epochs(flows.drop_repeats(timed, ["event_id"], "ts", "1 hour"), out, state)
    run.processAllAvailable()
    run.stop()
    return spark.read.schema(timed.schema).parquet(out).select("user_id", "event_type", "event_id")


_ERR = "(l_tax - l_discount)"


@query(
    "stream_sink",
    f"select l_orderkey, l_linenumber, l_partkey, {rs(f'{_ERR} * {_ERR}')} as mse_loss_per_point from lineitem",
)
def stream_sink(spark, d):
    err = F.col("l_tax") - F.col("l_discount")
    rows = _stream(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(err * err).alias("mse_loss_per_point")
    )
    return _drain(spark, rows)


@query(
    "stream_metrics",
    f"""select l_partkey as cpg_idx, count(*) as n, {corr_sql('l_tax', 'l_discount')} as pcc, {rs(f'avg({_ERR} * {_ERR})')} as mse,
               {rs(f'avg(abs({_ERR}))')} as mae from lineitem group by 1""",
)
def stream_metrics(spark, d):
    """Scores of everything seen so far; the state holds mergeable moments per site."""
    flows.use_disk_state(spark)
    err = F.col("l_tax") - F.col("l_discount")
    scores = (
        _stream(spark, d, "lineitem")
        .groupBy(F.col("l_partkey").alias("cpg_idx"))
        .agg(
            F.count("*").alias("n"),
            safe_corr("l_tax", "l_discount").alias("pcc"),
            F.avg(err * err).alias("mse"),
            F.avg(F.abs(err)).alias("mae"),
        )
    )
    out = staging_path(spark, "scores")
    flows.running_table(scores, out, staging_path(spark, "state")).awaitTermination()
    last = flows.latest(spark, out, ["cpg_idx"])
    return last.select("cpg_idx", "n", *[r6(c).alias(c) for c in ("pcc", "mse", "mae")])


def _shards_of(spark, d, name: str, key: str):
    """A table as numbered shards of neighbouring keys, so that a stream over it has several batches."""
    path = staging_path(spark, "shards")
    rows = table(spark, d, name)
    size = -(-rows.count() // _SHARDS) or 1
    write_equal_shards(rows, path, key.split(), size)
    return path


@query(
    "stream_metrics_by_group",
    f"""select l_linenumber % 3 as group_idx, l_partkey as cpg_idx, count(*) as n, {corr_sql('l_tax', 'l_discount')} as pcc,
               {rs(f'avg({_ERR} * {_ERR})')} as mse, {rs(f'avg(abs({_ERR}))')} as mae from lineitem group by 1, 2""",
)
def stream_metrics_by_group(spark, d):
    """Scores by split and site over six batches, merged into a new base every two."""
    path = _shards_of(spark, d, "lineitem", "l_orderkey l_linenumber")
    stream = flows.read_shards(spark, f"{path}/shard=*", table(spark, d, "lineitem").schema, files_per_trigger=2)
    keyed = stream.select((F.col("l_linenumber") % 3).alias("group_idx"), F.col("l_partkey").alias("cpg_idx"), "l_tax", "l_discount")
    store = MomentTable(spark, staging_path(spark, "moments"), ["group_idx", "cpg_idx"], compact_every=2)
    store.follow(keyed, "l_tax", "l_discount", staging_path(spark, "state")).awaitTermination()
    found = scores(store.moments(), store.keys)
    return found.select("group_idx", "cpg_idx", "n", *[r6(c).alias(c) for c in ("pcc", "mse", "mae")])


_SEED, _EPOCHS = 9176, 2


@query(
    "stream_epochs",
    f"""
with numbered as (
  select event_id, event_type, row_number() over (order by event_id) - 1 as r, (select count(*) from events) as total from events),
shards as (select *, r // ((total + {_SHARDS - 1}) // {_SHARDS}) as shard from numbered),
names as (select distinct shard, shard as i from shards),
turns as (
  select epoch, shard, row_number() over (partition by epoch order by sha256('{_SEED}:' || epoch || ':0:' || i)) as turn
  from names, range({_EPOCHS}) e(epoch)),
queued as (
  select epoch::int as epoch, event_id, event_type, total, row_number() over (partition by epoch order by turn, r) - 1 as place
  from shards join turns using (shard))
select epoch, place, event_id, event_type from queued where place < total * 3 // 4""",
)
def stream_epochs(spark, d):
    """Two seeded epochs of three quarters of the events each."""
    path = _shards_of(spark, d, "events", "event_id")
    rows = table(spark, d, "events").count() * 3 // 4
    out, state = staging_path(spark, "epochs"), staging_path(spark, "state")
    stream = epochs.read_epochs(
        spark, path, state, "event_id bigint, event_type string", seed=_SEED, epochs=_EPOCHS, rows_per_epoch=rows, shards_per_batch=5
    )
    run = epochs.append_epochs(stream, out, state)
    run.processAllAvailable()
    run.stop()
    return spark.read.schema(stream.schema).parquet(out).select("epoch", "place", "event_id", "event_type")
