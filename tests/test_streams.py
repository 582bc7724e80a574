"""Streams: restart after some files, repeats, running scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.functions.numeric import safe_corr
from sitewise.streaming import flows

SCHEMA = "cpg_idx int, sample_idx int, pred_methyl double, gt_methyl double"


@pytest.fixture
def shards(spark, tmp_path):
    """Writes a numbered shard on demand; returns the folder and the writer."""
    rng = np.random.default_rng(3)
    folder = tmp_path / "in"
    folder.mkdir()

    def add(no: int, repeat_from: int | None = None):
        r = np.random.default_rng(repeat_from) if repeat_from is not None else np.random.default_rng(no)
        rows = [(int(c), int(s), float(r.random()), float(r.random())) for c, s in zip(r.integers(0, 5, 200), range(200))]
        if repeat_from is None:
            rows = [(c, s + 1000 * no, p, g) for c, s, p, g in rows]
        else:
            rows = [(c, s + 1000 * repeat_from, p, g) for c, s, p, g in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        return rng

    return str(folder), add


def test_append_resumes_without_loss_or_repeat(spark, tmp_path, shards):
    folder, add = shards
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        flows.append(flows.read_shards(spark, folder, SCHEMA, files_per_trigger=1), out, state).awaitTermination()

    for no in range(3):
        add(no)
    run()
    assert spark.read.parquet(out).count() == 600
    add(3)
    run()
    run()
    got = spark.read.parquet(out)
    assert got.count() == 800
    assert got.exceptAll(spark.read.parquet(folder)).count() == 0


def test_repeats_are_dropped_across_a_restart(spark, tmp_path, shards):
    folder, add = shards
    flows.use_disk_state(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = flows.read_shards(spark, folder, SCHEMA, files_per_trigger=1)
        flows.append(flows.drop_repeats(stream, ["cpg_idx", "sample_idx"]), out, state).awaitTermination()

    add(0)
    add(1)
    run()
    add(9, repeat_from=1)
    run()
    assert spark.read.parquet(out).count() == spark.read.parquet(folder).select("cpg_idx", "sample_idx").distinct().count() == 400


def test_running_scores_equal_batch_scores(spark, tmp_path, shards):
    folder, add = shards
    flows.use_disk_state(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def scores(df):
        return df.groupBy("cpg_idx").agg(F.count("*").alias("n"), safe_corr("pred_methyl", "gt_methyl").alias("pcc"))

    def run():
        stream = flows.read_shards(spark, folder, SCHEMA, files_per_trigger=1)
        query = flows.running_table(scores(stream), out, state)
        query.awaitTermination()
        return query

    add(0)
    add(1)
    query = run()
    assert sum(p["rows"] for p in flows.progress_rates(query)) == 400
    add(2)
    run()
    got = {r.cpg_idx: (r.n, r.pcc) for r in flows.latest(spark, out, ["cpg_idx"]).collect()}
    for r in scores(spark.read.parquet(folder)).collect():
        assert got[r.cpg_idx][0] == r.n and abs(got[r.cpg_idx][1] - r.pcc) < 1e-12


def test_a_stream_takes_the_batch_functions(spark, tmp_path, shards):
    folder, add = shards
    add(0)
    doubled = flows.transform(
        flows.read_shards(spark, folder, SCHEMA), lambda s: s.withColumn("d", F.col("pred_methyl") * 2), lambda s: s.select("d")
    )
    flows.append(doubled, str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 200
