"""Order digests, densities and block sums against plain versions."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sitewise.operators import cohort, metrics, order


def number(*keys) -> int:
    text = "|".join("null" if k is None else f"={k}" for k in keys)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_digest(rows) -> int:
    return sum(number(*r) % order.PRIME * pow(order.BASE, i, order.PRIME) for i, r in enumerate(rows)) % order.PRIME


def shards(spark, path, rows, sizes):
    at = 0
    for nth, size in enumerate(sizes):
        part = rows[at : at + size]
        made = pa.table({"a": pa.array([r[0] for r in part], pa.int64()), "b": pa.array([r[1] for r in part], pa.string())})
        pq.write_table(made, f"{path}/{nth:05d}.parquet")
        at += size
    return order.shard_rows(spark, str(path), ["a", "b"])


@pytest.mark.parametrize("side", [2, 64])
def test_order_of_shard_sets(spark, tmp_path, monkeypatch, side):
    """Blocks of 4 places take several levels, the usual ones a single level."""
    monkeypatch.setattr(order, "_SIDE", side)
    monkeypatch.setattr(order, "BLOCK", side * side)
    rng = random.Random(side)
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([None, "null", "=", str(i)])) for i in range(150)]
    rows[77], rows[91] = (1, "left"), (2, "right")
    moved = list(rows)
    moved[77], moved[91] = rows[91], rows[77]
    changed = [*rows[:149], (5, "other")]
    sets = {"base": (rows, [50, 50, 50]), "resharded": (rows, [1, 100, 0, 49]), "moved": (moved, [75, 75]), "changed": (changed, [150]), "shorter": (rows[:120], [60, 60])}
    frames = {}
    for name, (data, sizes) in sets.items():
        (tmp_path / name).mkdir()
        frames[name] = shards(spark, tmp_path / name, data, sizes)
    for name, (data, _) in sets.items():
        got = order.compare_order(frames["base"], frames[name], ["a", "b"]).first()
        first = next((i for i in range(150) if i >= len(data) or data[i] != rows[i]), None)
        assert (got["n_left"], got["n_right"]) == (150, len(data))
        assert (got["digest_left"], got["digest_right"]) == (plain_digest(rows), plain_digest(data))
        assert got["first_difference"] == first and got["same_order"] == (first is None)
        assert got["same_rows"] == (name in ("base", "resharded", "moved"))
    nothing = frames["base"].limit(0)
    got = order.compare_order(nothing, nothing, ["a", "b"]).first()
    assert got["same_order"] and got["same_rows"] and got["n_left"] == 0


def test_density_equals_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {1: rng.normal(0.2, 0.1, 500), 2: np.array([0.25, 0.75]), 3: np.full(9, 0.5), None: rng.random(80), 4: np.array([0.1])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(1, None), (5, None)]
    got = metrics.density(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", points=60).toPandas()
    assert set(got["g"].fillna(-1)) == {1, 2, -1}
    for g in (1, 2, None):
        v = groups[g]
        made = got[got["g"].isna() if g is None else got["g"] == g].sort_values("point")
        h = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - 2 * h, v.max() + 2 * h, 60)
        exact = np.exp(-0.5 * ((x[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.allclose(made["x"], x) and np.allclose(made["bandwidth"], h) and (made["n"] == len(v)).all()
        assert np.abs(made["density"] - exact).max() < 0.02 * exact.max()
        assert abs(made["density"].sum() * (x[1] - x[0]) - 1) < 0.06


@pytest.mark.parametrize("cells,bins,pairs", [(1, 1, 0), (50, 3, 1), (1000, 7, 2), (10**6, 4096, 256)])
def test_block_sums_do_not_depend_on_buffers(spark, cells, bins, pairs):
    rng = np.random.default_rng(cells)
    rows = [(f"c{b % 3}", int(b // 3), int(g), float(rng.random())) for b in range(90) for g in (0, 1, 5, 8, 9, 17, 30) if rng.random() < 0.7]
    pdf = pd.DataFrame(rows, columns=["chr", "bin", "g", "v"])
    frame = spark.createDataFrame(pdf)
    got = cohort.sample_correlations(frame, "g", "v", block=8, bins_per_group=11, cells_held=cells, bins_held=bins, pairs_held=pairs).toPandas()
    want = pdf.pivot(index=["chr", "bin"], columns="g", values="v")
    assert len(got) == 28
    for r in got.itertuples():
        both = want[[r.group_a]].join(want[[r.group_b]], rsuffix="_").dropna()
        assert r.n == len(both) and abs(r.pcc - np.corrcoef(both.iloc[:, 0], both.iloc[:, -1])[0, 1]) < 1e-9


def test_pairs_of_groups_are_finished_where_their_blocks_meet(spark):
    """No sum of a pair is shuffled, whatever the share of bins that two groups have in common."""
    rng = np.random.default_rng(11)
    rows = [("c", b, g, float(rng.random())) for b in range(150) for g in range(42) if rng.random() < (0.9 if b < 6 else 0.06)]
    rows += [("d", b, g, 0.1) for b in range(7) for g in (42, 43)] + [("d", 7, 42, 0.7), ("d", 8, 43, 0.6), ("d", 1, 44, None)]
    pdf = pd.DataFrame(rows, columns=["chr", "bin", "g", "v"])
    frame = spark.createDataFrame(rows, "chr string, bin bigint, g bigint, v double")
    pairs = cohort.sample_correlations(frame, "g", "v", block=4, cells_held=200, bins_held=2)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(group_a" not in plan
    want = pdf.dropna().pivot(index=["chr", "bin"], columns="g", values="v")
    n = want.notna().astype(int)
    n, pcc = n.T @ n, want.corr(min_periods=2)
    got = {(r.group_a, r.group_b): r for r in pairs.collect()}
    assert set(got) == {(a, b) for a in n for b in n if a <= b and n.loc[a, b] > 0}
    for (a, b), r in got.items():
        assert r.n == n.loc[a, b]
        if r.n > 2 and a < 42:
            assert abs(r.pcc - pcc.loc[a, b]) < 1e-9
    assert got[42, 43].n == 7 and got[42, 43].pcc is None and abs(got[42, 42].pcc - 1) < 1e-9
    rounded = cohort.sample_correlations(frame, "g", "v", block=4, cells_held=200, decimals=3).where("group_a < group_b")
    assert all(r.pcc is None or abs(r.pcc - got[r.group_a, r.group_b].pcc) < 5.1e-4 and round(r.pcc, 3) == r.pcc for r in rounded.collect())


def test_blocks_of_groups_are_large_and_few(spark):
    """Cells are sent once per block, and a block is many of the parts that a task unpacks at a time."""
    rng = np.random.default_rng(12)
    rows = [("c", int(b), g, float(rng.random())) for g in range(65) for b in rng.permutation(30)[:10]]
    want = pd.DataFrame(rows, columns=["chr", "bin", "g", "v"]).pivot(index="bin", columns="g", values="v")
    n, pcc = want.notna().astype(int).T @ want.notna().astype(int), want.corr(min_periods=3)
    frame = spark.createDataFrame(rows, "chr string, bin bigint, g bigint, v double")
    for held, tasks in ((16, 153), (1, 561)):
        pairs = cohort.sample_correlations(frame, "g", "v", block=2, cells_held=20, parts_held=held)
        assert pairs.rdd.getNumPartitions() == tasks
        if held > 1:
            got = pairs.collect()
            assert sorted((r.group_a, r.group_b) for r in got) == [(a, b) for a in n for b in n if a <= b and n.loc[a, b] > 0]
            assert all(r.n == n.loc[r.group_a, r.group_b] for r in got)
            assert all(r.n < 3 or abs(r.pcc - pcc.loc[r.group_a, r.group_b]) < 1e-9 for r in got)
    cells = np.array([3, 9, 2], "i4"), np.array([0, 0, 7], "i4"), np.array([0.5, -1.0, 1e300])
    assert all((x == y).all() for x, y in zip(cohort._unpacked(3, cohort._packed(*cells)), cells, strict=True))


def test_no_cells_give_no_correlations(spark):
    empty = spark.createDataFrame([("c", 1, 0, None)], "chr string, bin bigint, g bigint, v double")
    assert cohort.sample_correlations(empty, "g", "v").count() == 0
