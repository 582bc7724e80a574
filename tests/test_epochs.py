"""Seeded epochs that go on after a stop, and running moments that are merged as they come."""

import numpy as np
import pandas as pd
import pytest

from sitewise.streaming import epochs, flows
from sitewise.streaming.moments import MomentTable, batch_moments, merge, scores

SIZES = [5, 1, 0, 9, 3, 7]


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "shards"
    path.mkdir()
    at = 0
    for nth, size in enumerate(SIZES):
        pd.DataFrame({"id": range(at, at + size), "v": [f"t{i}" for i in range(at, at + size)]}).astype({"id": "int64", "v": "str"}).to_parquet(path / f"{nth}.parquet")
        at += size
    return path


def expected(seed, n_epochs, limit):
    starts = np.cumsum([0, *SIZES])
    out = []
    for e in range(n_epochs):
        rows, round_no = [], 0
        while round_no == 0 or (limit is not None and len(rows) < limit):
            for i in epochs.shard_order(seed, e, round_no, len(SIZES)):
                rows += range(starts[i], starts[i + 1])
            round_no += 1
        rows = rows if limit is None else rows[:limit]
        out += [(e, p, i) for p, i in enumerate(rows)]
    return out


def run(spark, folder, state, out, fail_at=None, **options):
    """Drain the stream into one folder per batch; a batch that runs again replaces its own."""

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id == fail_at:
            raise RuntimeError("stopped by the test")

    stream = epochs.read_epochs(spark, str(folder), str(state), "id bigint, v string", **options)
    query = stream.writeStream.option("checkpointLocation", str(state)).foreachBatch(save).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r["epoch"], r["place"], r["id"]) for r in spark.read.parquet(str(out)).collect())


@pytest.mark.parametrize("limit", [None, 13, 25, 60])
def test_epochs_go_on_in_the_middle(spark, folder, tmp_path, limit):
    options = {"seed": 3, "epochs": 2, "rows_per_epoch": limit, "shards_per_batch": 2}
    want = expected(3, 2, limit)
    state, out = tmp_path / "state", tmp_path / "out"
    with pytest.raises(Exception, match="stopped by the test"):
        run(spark, folder, state, out, fail_at=1, **options)
    assert run(spark, folder, state, out, **options) == want
    assert run(spark, folder, state, out, **options) == want
    first, second = ([i for e, _, i in want if e == k] for k in (0, 1))
    assert first != second
    assert [i for _, _, i in expected(4, 2, limit)] != [i for _, _, i in want]


def test_no_shards_no_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = epochs.read_epochs(spark, str(tmp_path / "none"), str(tmp_path / "state"), "id bigint, v string")
    query = epochs.append_epochs(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.schema("id bigint").parquet(str(tmp_path / "out")).count() == 0


def test_moments_by_group_and_key(spark, tmp_path):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 600), "k": rng.integers(0, 7, 600), "x": 1e6 + rng.random(600), "y": rng.random(600)})
    pdf.loc[pdf["k"] == 6, "x"] = 0.5
    pdf.loc[::50, "y"] = np.nan
    source = tmp_path / "in"
    source.mkdir()
    for i in range(7):
        pdf.iloc[i::7].to_parquet(source / f"{i}.parquet", index=False)
    store = MomentTable(spark, str(tmp_path / "table"), ["g", "k"], compact_every=3)
    assert store.moments() is None
    stream = flows.read_shards(spark, str(source), "g long, k long, x double, y double", files_per_trigger=1)
    store.follow(stream, "x", "y", str(tmp_path / "state")).awaitTermination()
    assert store.folders() == ["base=5", "delta=6"]
    # A batch that a crash makes run again, before and after its base was written.
    again = batch_moments(spark.createDataFrame(pdf.iloc[6::7]), ["g", "k"], "x", "y")
    store.save(again, 6)
    store.save(again, 4)
    assert store.folders() == ["base=5", "delta=6"]
    got = scores(store.moments(), ["g", "k"]).toPandas().set_index(["g", "k"])
    full = pdf.dropna()
    assert len(got) == len(full.groupby(["g", "k"]))
    for key, part in full.groupby(["g", "k"]):
        r = got.loc[key]
        assert r["n"] == len(part) and np.isclose(r["mse"], ((part["x"] - part["y"]) ** 2).mean())
        assert np.isclose(r["mae"], (part["x"] - part["y"]).abs().mean())
        assert np.isnan(r["pcc"]) if key[1] == 6 else abs(r["pcc"] - part["x"].corr(part["y"])) < 1e-6


def test_a_constant_has_no_correlation_after_merges(spark):
    """Three times 0.1 has a rounded mean above 0.1; a batch with one 0.1 more adds no spread."""
    parts = [
        batch_moments(spark.createDataFrame([(1, 0.1, y) for y in ys], "k long, x double, y double"), ["k"], "x", "y")
        for ys in ([0.25, 0.5, 0.75], [1.5], [0.125] * 7)
    ]
    both = scores(merge(parts, ["k"]), ["k"]).collect()
    assert [(r["n"], r["pcc"]) for r in both] == [(11, None)]
