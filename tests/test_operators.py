"""Operators against brute force on small inputs in which one key holds a third of the rows or more."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import annotation, audits, cohort, coverage, export, ids, inference, metrics, moving, nearest
from sitewise.operators import profile, ranking, reshape, sets, splits, staging, windows

RNG = np.random.default_rng(7)


def skewed(n=3000):
    """Rows (k, v, id): key `hot` holds half of them, values repeat."""
    k = np.where(RNG.random(n) < 0.5, "hot", np.char.add("k", RNG.integers(0, 40, n).astype(str)))
    return pd.DataFrame({"k": k, "v": RNG.integers(0, 50, n).astype(float), "id": np.arange(n)})


def test_ranked_equals_row_number(spark):
    pdf = skewed()
    got = ranking.ranked(spark.createDataFrame(pdf), ["k"], ["v", "id"], "r").toPandas().sort_values("id")
    want = pdf.sort_values(["k", "v", "id"]).groupby("k").cumcount().sort_index()
    assert (got["r"].to_numpy() == want.to_numpy()).all()


def test_ranked_descending_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 2), ("a", 5), (None, 2)], "k string, v int")
    got = {(r.k, r.v): r.r for r in ranking.ranked(df, ["k"], [F.col("v").desc()], "r").collect()}
    assert got == {(None, 3): 0, (None, 2): 1, (None, 1): 2, ("a", 5): 0, ("a", 2): 1}


def test_hash_ranked_is_a_permutation_and_repeats(spark):
    df = spark.createDataFrame(skewed()[["k", "id"]])
    a = ranking.hash_ranked(df, ["k"], ["id"], 1, "r", "n").toPandas()
    b = ranking.hash_ranked(df.repartition(7), ["k"], ["id"], 1, "r").toPandas()
    c = ranking.hash_ranked(df, ["k"], ["id"], 2, "r").toPandas()
    for _, part in a.groupby("k"):
        assert sorted(part["r"]) == list(range(len(part))) and (part["n"] == len(part)).all()
    same = a.merge(b, on=["k", "id"])
    assert (same["r_x"] == same["r_y"]).all()
    assert (a.merge(c, on=["k", "id"]).eval("r_x != r_y")).any()


def test_exact_quantiles_equal_pandas(spark):
    pdf = skewed()
    pdf.loc[::17, "v"] = np.nan
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = ranking.exact_quantiles(df, ["k"], "v", probs, ["id"]).toPandas().set_index(["k", "q"])["quantile"].sort_index()
    want = pdf.groupby("k")["v"].quantile(probs).sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_windows_equal_substring(spark):
    seqs = {"chr1": "".join(RNG.choice(list("acgtACGTN"), 997)), "chr2": "ACG", "chr3": "C" * 64}
    sites = [(i, c, int(p)) for i, (c, p) in enumerate((c, p) for c, s in seqs.items() for p in range(0, len(s), 3))]
    df = spark.createDataFrame(sites, "cpg_idx int, chr string, pos bigint")
    contigs = spark.createDataFrame(list(seqs.items()), "chr string, seq string")
    for width, n in ((64, 40), (16, 40), (2000, 10)):
        got = windows.site_windows(df, windows.tile_sequences(contigs, width, n), width, n).collect()
        assert len(got) == len(sites)
        for r in got:
            padded = "N" * (n // 2) + seqs[r.chr] + "N" * (n // 2)
            assert r.sequence == padded[r.pos : r.pos + n] and len(r.sequence) == n and r.base == seqs[r.chr][r.pos]


def test_coverage_equals_base_counts(spark):
    rows = [("chr1", int(p), "train" if RNG.random() < 0.7 else "val") for p in RNG.integers(0, 900, 150)]
    rows += [("chr1", 500, "train")] * 60 + [("chr2", 5, "val"), ("chr3", 0, "train")]
    n = 50
    got = {r.chr: r for r in coverage.split_overlap(spark.createDataFrame(rows, "chr string, pos bigint, split string"), n, width=64).collect()}
    for c in ("chr1", "chr2", "chr3"):
        top = max(p for ch, p, _ in rows if ch == c)
        count = {s: np.zeros(top + n) for s in ("train", "val")}
        for ch, p, s in rows:
            if ch == c:
                count[s][p : min(top, p + n)] += 1
        both = ((count["train"] > 0) & (count["val"] > 0)).sum()
        used = ((count["train"] > 0) | (count["val"] > 0)).sum()
        assert (got[c].num_overlap, got[c].num_used, got[c].num_bases) == (both, used, top + n)
    assert got["chr3"].ratio_used is None


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_genes_with_ties_and_a_hot_chromosome(spark, k):
    genes = pd.DataFrame({"gene_idx": np.arange(400), "chr": np.where(np.arange(400) % 3 < 2, "chr1", "chr2")})
    genes["gene_pos"] = RNG.integers(0, 120, 400) * 5
    sites = pd.DataFrame({"cpg_idx": np.arange(150), "chr": np.where(np.arange(150) % 5 < 4, "chr1", "chr2")})
    sites["pos"] = RNG.integers(0, 700, 150)
    got = nearest.nearest_genes(spark.createDataFrame(sites), spark.createDataFrame(genes), k).toPandas()
    both = sites.merge(genes, on="chr")
    both["d"] = (both["gene_pos"] - both["pos"]).abs()
    want = both.sort_values(["cpg_idx", "d", "gene_idx"]).groupby("cpg_idx").head(k)
    got = got.sort_values(["cpg_idx", "place"])
    assert got["gene_idx"].tolist() == want["gene_idx"].tolist()
    assert got["distance"].tolist() == want["d"].tolist()


def test_dedupe_and_drop_repeated(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    first = sets.dedupe(df, ["k"], ["id"]).toPandas().sort_values("k")
    last = sets.dedupe(df, ["k"], ["id"], keep="last").toPandas().sort_values("k")
    assert first["id"].tolist() == pdf.groupby("k")["id"].min().tolist()
    assert last["id"].tolist() == pdf.groupby("k")["id"].max().tolist()
    few = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert [tuple(r) for r in sets.drop_repeated(few, ["k"]).collect()] == [("b", 3)]


def test_merge_matrices(spark):
    a = spark.createDataFrame([("g1", "s1", 1.0), ("g2", "s1", 2.0), ("g3", "s1", None)], "g string, s string, v double")
    b = spark.createDataFrame([("g1", "s1", 1.0000001), ("g2", "s1", 2.5), ("g3", "s1", None), ("g1", "s2", 7.0)], "g string, s string, v double")
    got = {(r.g, r.s): (r.v, r.agrees) for r in sets.merge_matrices(sets.tag_sources([a, b]), "g", "s", "v", 2).collect()}
    assert got == {("g1", "s1"): (1.0, True), ("g2", "s1"): (2.0, False), ("g3", "s1"): (None, False), ("g1", "s2"): (7.0, True)}


def test_key_pool_and_subsets(spark):
    keys = spark.createDataFrame([(c,) for c in "abcdef"], "chr_pos string")
    part = lambda t: spark.createDataFrame([(c,) for c in t], "chr_pos string")
    pool = lambda *a, **k: sorted(r.chr_pos for r in sets.key_pool(keys, *a, **k).collect())
    assert pool([], [part("ab")], key="chr_pos", start="all") == list("cdef")
    assert pool([part("abc"), part("cd")], [part("b")], key="chr_pos", start="null") == list("acd")
    assert pool([], [], key="chr_pos", start="null") == []
    assert [r.chr_pos for r in sets.not_subset(part("az"), keys, "chr_pos").collect()] == ["z"]
    with pytest.raises(ValueError):
        sets.key_pool(keys, [], [], "chr_pos", "some")


def test_splits_are_disjoint_and_cover(spark):
    sites = pd.DataFrame({"chr_pos": [f"s{i}" for i in range(1000)], "chr": np.where(np.arange(1000) % 3 == 0, "chr1", "chr2")})
    got = splits.split_sites(spark.createDataFrame(sites), 0.1, 0.01, 42).toPandas()
    assert sorted(got["chr_pos"]) == sorted(sites["chr_pos"])
    for _, part in got.groupby("chr"):
        n = part["split"].value_counts()
        assert n["val"] == int(len(part) * 0.1) and n["train"] == int(len(part) * 0.01)
    samples = pd.DataFrame({"sample_name": [f"x{i}" for i in range(11)], "tissue_name": list("abbcccddddd")})
    got = splits.split_samples(spark.createDataFrame(samples), 0.5, 1).toPandas()
    train = got[got["split"] == "train"]["tissue_name"].value_counts()
    assert (train["a"], train["b"], train["c"], train["d"]) == (1, 1, 2, 2)
    held = splits.hold_out_tissues(spark.createDataFrame(samples), 5, 1).where("split = 'val'").toPandas()
    assert held["tissue_name"].tolist() == ["a"]


def test_sample_ids_keep_na_last(spark):
    names = spark.createDataFrame([("s3",), ("s1",), ("s2",), ("s4",)], "sample_name string")
    known = spark.createDataFrame([("s4", "LIV"), ("s1", "NA"), ("s3", "ADR"), ("s9", "X")], "sample_name string, tissue_name string")
    got = ids.sample_dimension(names, known, 10, 5).orderBy("sample_idx").collect()
    assert [(r.sample_idx, r.sample_name, r.tissue_name, r.tissue_idx, r["count"]) for r in got] == [
        (10, "s1", "NA", 5, 2), (11, "s3", "ADR", 6, 1), (12, "s4", "LIV", 7, 1), (13, "s2", "NA", 5, 2)]


def test_melt_then_spread_is_the_identity(spark):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 4.0)], "key string, `s.1` double, s2 double")
    long = reshape.melt(wide, ["key"], ["s.1", "s2"], "sample", "value")
    assert long.count() == 4
    back = reshape.spread(long, ["key"], "sample", "value", ["s.1", "s2"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_ragged_rows(spark):
    lines = spark.createDataFrame([("Sample,Cancer",), ("C1,BRCA",), ("C3L-00088, C3L-00088,NA",)], "value string")
    assert sorted(map(tuple, reshape.ragged_rows(lines).collect())) == [(" C3L-00088", "NA"), ("C1", "BRCA"), ("C3L-00088", "NA")]
    with pytest.raises(Exception, match="unexpected"):
        reshape.ragged_rows(spark.createDataFrame([("a,b,c",)], "value string")).collect()


def test_one_vector_per_sample(spark):
    df = spark.createDataFrame([(s, p, float(p)) for s in (1, 2) for p in range(10)], "s int, p bigint, v double")
    vectors = reshape.sample_vectors(df, "s", "p", "v")
    assert {r.s: r.vector for r in vectors.collect()} == {1: [float(p) for p in range(10)], 2: [float(p) for p in range(10)]}
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "site int, s int")
    assert reshape.attach_vectors(pairs, vectors, "s").count() == 3
    assert [r.s for r in reshape.without_vector(pairs, vectors, "s").collect()] == [3]


def test_long_vectors_come_in_small_tasks(spark):
    """No task makes more than twice the given bytes, however the pairs of the samples are dealt."""
    n = reshape.RUN + 3
    cells = spark.range(2 * n).selectExpr("id % 2 as s", "cast(id / 2 as bigint) as p", "cast(cast(id / 2 as bigint) % 10 as string) as v")
    texts = reshape.sample_texts(cells, "s", "p", "v")
    text = ",".join(str(p % 10) for p in range(n))
    assert {r.s: r.vector for r in texts.collect()} == {0: text, 1: text}
    pairs = spark.range(90).selectExpr("id as site", "case when id < 70 then 0 when id < 80 then 1 when id < 89 then 2 end as s")
    got = reshape.attach_vectors(pairs, texts, "s", task_bytes=5 * len(text))
    rows = got.select("site", "s", "vector", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.site for r in rows) == list(range(90))
    assert all(r.vector == (text if r.site < 80 else None) and r.s == (0 if r.site < 70 else 1 if r.site < 80 else 2 if r.site < 89 else None) for r in rows)
    tasks = pd.Series([r.task for r in rows if r.vector]).value_counts()
    assert tasks.max() <= 10 and len(tasks) == 16
    long = cells.select("s", "p", F.col("v").cast("double").alias("v"))
    arrays = reshape.attach_vectors(pairs, reshape.sample_vectors(long, "s", "p", "v"), "s", task_bytes=1)
    assert [list(r.vector) for r in arrays.where("site = 75").collect()] == [[float(p % 10) for p in range(n)]]


def test_a_task_gets_a_long_vector_once(spark):
    """Pairs of a sample share the copy of their vector up to twice the bytes of a task, and copies travel in runs."""
    text = "0123456789" * 100
    texts = spark.createDataFrame([(0, text), (1, text[::-1]), (7, text)], "s int, v string")
    pairs = spark.range(80).selectExpr("id as site", "case when id < 70 then 0 else 1 end as s")
    got = reshape.attach_vectors(pairs, texts, "s", task_bytes=1500)
    rows = got.select("site", "s", "v", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.site for r in rows) == list(range(80))
    assert all(r.v == (text[::-1] if r.s else text) for r in rows)
    assert len({(r.task, r.s) for r in rows}) == 40
    assert max(pd.Series([r.task for r in rows]).value_counts()) == 2


def test_vectors_are_cut_and_put_together(spark, monkeypatch):
    monkeypatch.setattr(reshape, "PIECE", 3)
    pairs = spark.createDataFrame(list(enumerate([1, 1, 2, 3, None, 4, 5, 1])), "site int, s int")
    samples = [r.s for r in pairs.orderBy("site").collect()]
    texts = {1: "a\nb,,c \U0001f600\u00e9d", 2: "", 3: None, 5: "xyz", None: "q"}
    arrays = {1: [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0], 2: [], 3: None, 5: [None], None: [0.0]}
    for held, kind in ((texts, "string"), (arrays, "array<double>")):
        frame = spark.createDataFrame(list(held.items()), f"s int, v {kind}")
        for size in (1, 40, 1 << 20):
            rows = reshape.attach_vectors(pairs, frame, "s", task_bytes=size).orderBy("site").collect()
            assert [r.s for r in rows] == samples
            assert [r.v for r in rows] == [None if s is None else held.get(s) for s in samples]
    cells = spark.range(40).selectExpr("id % 2 as s", "cast(id / 2 as bigint) as p", "case when id % 7 > 0 then cast(id as string) end as v")
    monkeypatch.setattr(reshape, "RUN", 4)
    runs, whole = reshape.text_runs(cells, "s", "p", "v"), reshape.sample_texts(cells, "s", "p", "v")
    pairs = spark.range(9).selectExpr("id as site", "id % 3 as s")
    want = {r.s: r.vector for r in whole.collect()}
    assert all(r.vector == want.get(r.s) for r in reshape.attach_runs(pairs, runs, "s").collect())


def test_subset_prunes_and_hot_key_ranks(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")))
    small = splits.random_subset(df, 40, ["id"], 3)
    ranks = ranking.hash_ranked(df, [], ["id"], 3, "r")
    assert {r.id for r in small.collect()} == {r.id for r in ranks.where("r < 40").collect()}
    got = ranking.ranked(df, ["k"], ["id"], "r").where("k = 'hot'").orderBy("id").toPandas()
    assert got["r"].tolist() == list(range(4500))


def test_moving_rate_over_block_borders(spark):
    n = 400
    pdf = pd.DataFrame({"run": "r", "no": np.arange(n), "a": RNG.random(n)})
    pdf["ts"] = pd.Timestamp("2024-03-10") + pd.to_timedelta(np.cumsum(RNG.random(n)), unit="s")
    got = moving.moving_rate(spark.createDataFrame(pdf), "run", ["ts", "no"], "ts", "a", 10, block=32).toPandas().sort_values("no")
    assert np.allclose(got["amount"], pdf["a"].rolling(10, min_periods=1).sum())
    start = pdf["ts"].shift(9).fillna(pdf["ts"].iloc[0])
    assert np.allclose(got["seconds"], (pdf["ts"] - start).dt.total_seconds(), atol=1e-5)


def test_sample_correlations_equal_pandas(spark):
    pdf = pd.DataFrame([("c", int(b), int(g), float(RNG.random())) for b in range(60) for g in range(20) if RNG.random() < 0.8],
                       columns=["chr", "bin", "g", "v"])
    pdf.loc[pdf["g"] == 3, "v"] = 0.1
    got = cohort.sample_correlations(spark.createDataFrame(pdf), "g", "v", block=8, bins_per_group=7).toPandas()
    want = pdf.pivot(index="bin", columns="g", values="v").corr()
    assert len(got) == 210
    for r in got.itertuples():
        w = want.loc[r.group_a, r.group_b]
        assert (np.isnan(r.pcc) and (np.isnan(w) or 3 in (r.group_a, r.group_b))) or abs(r.pcc - w) < 1e-9


def test_quantile_bins_equal_numpy(spark):
    pdf = pd.DataFrame([(s, g, float(max(0, RNG.integers(-5, 30)))) for s in (1, 2, 3) for g in range(80)], columns=["s", "g", "v"])
    pdf.loc[pdf["s"] == 3, "v"] = 0.0
    got = annotation.quantile_bins(spark.createDataFrame(pdf), "s", "v", 11, ["g"]).toPandas()
    for s, part in got.groupby("s"):
        v = part["v"].to_numpy()
        want = np.zeros(len(v), dtype=int)
        if (v > 0).any():
            want[v > 0] = np.digitize(v[v > 0], np.quantile(v[v > 0], np.linspace(0, 1, 10)))
            assert part["bin"].max() == 10
        assert (part["bin"].to_numpy() == want).all()


def test_metric_summary_leaves_undefined_out(spark):
    rows = [(g, c, s, float(RNG.random()), float(RNG.random())) for g in (0, 1) for c in range(6) for s in range(9)]
    rows += [(1, 99, s, 0.5, float(s)) for s in range(3)] + [(1, 98, 1, 0.1, 0.2), (1, 97, 1, float("nan"), 0.2)]
    df = spark.createDataFrame(rows, "group_idx int, cpg_idx int, sample_idx int, pred_methyl double, gt_methyl double")
    got = metrics.metric_summary(df).toPandas().set_index("group_idx")
    pdf = df.toPandas().dropna()
    for g, part in pdf.groupby("group_idx"):
        by = {k: part.groupby(k)[["pred_methyl", "gt_methyl"]].corr().unstack().iloc[:, 1] for k in ("cpg_idx", "sample_idx")}
        d = part["pred_methyl"] - part["gt_methyl"]
        want = [(d**2).mean(), d.abs().mean(), by["cpg_idx"].mean(), by["sample_idx"].mean(), by["cpg_idx"].median(), by["sample_idx"].median()]
        assert np.allclose(got.loc[g].to_numpy(), want)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([("chr1", 0, "t", 9.0), ("chr1", 3000, "t", 1.0), ("chr1", 3001, "t", 2.0), ("chr2", 1, "t", 3.0)],
                               "chr string, pos bigint, tissue string, v double")
    rows = profile.bin_means(df, 3000, "tissue", "v", drop_first_bin=False)
    assert sorted(map(tuple, rows.collect())) == [("chr1", 1, "t", 1.0), ("chr1", 2, "t", 2.0), ("chr2", 1, "t", 3.0)]
    assert profile.bin_means(df, 3000, "tissue", "v", drop_first_bin=True).count() == 2


def test_audits(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in audits.null_violations(df, "k", ["v"]).collect()] == [("not_null", "b", "v")]
    with pytest.raises(ValueError, match="not_null"):
        audits.enforce(audits.null_violations(df, "k", ["v"]))
    audits.enforce(audits.null_violations(df.where("k = 'a'"), "k", ["v"]))
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "i int, n string")
    assert sorted(tuple(r) for r in audits.one_to_one(pairs, "i", "n").collect()) == [("i_to_n", "1", "2"), ("n_to_i", "x", "2")]
    have = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    want = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, n int")
    assert sorted(r.key for r in audits.total_violations(have, want, "k", "n").collect()) == ["b", "c"]
    assert [r.key for r in ids.unmatched(have, want.where("k = 'a'"), "k", "known").collect()] == ["b"]
    bad = spark.createDataFrame([("k1", "train"), ("k1", "val"), ("k9", "val")], "k string, split string")
    counts = {r.check: r.violations for r in audits.split_audit(bad, spark.createDataFrame([("k1",), ("k2",)], "k string"), "k").collect()}
    assert counts == {"overlap": 1, "missing": 1, "unknown": 1}


def test_side_by_side_keeps_all_keys(spark):
    f = lambda rows: spark.createDataFrame(rows, "k int, v double")
    got = sorted(map(tuple, metrics.side_by_side({"a": f([(1, 1.0)]), "b": f([(1, 2.0), (2, 3.0)])}, "k", "v").collect()))
    assert got == [(1, 1.0, 2.0), (2, None, 3.0)]


def test_export_by_recipe(spark):
    pairs = spark.createDataFrame([(1, 1, 0.5, "array", "train"), (2, 1, 0.6, "epic", "train"), (1, 1, 0.7, "wgbs", "train")],
                                  "cpg_idx int, sample_idx int, methylation double, source string, split string")
    sites = spark.createDataFrame([(1, "chr1", 5, "chr1_5", 0), (2, "chr2", 7, "chr2_7", 1)], "cpg_idx int, chr string, pos int, chr_pos string, chr_idx int")
    samples = spark.createDataFrame([(1, 4)], "sample_idx int, tissue_idx int")
    recipe = export.recipe_table(spark, [("epic", "train"), ("array", "train")])
    got = export.export_pairs(pairs, sites, samples, recipe).orderBy("group_idx").collect()
    assert [(r.cpg_idx, r.group_idx, r.chr_idx, r.tissue_idx) for r in got] == [(2, 0, 1, 4), (1, 1, 0, 4)]


def test_tokenizer_hook(spark):
    df = spark.createDataFrame([("ACGT",), ("AAA",)], "sequence string")
    make = lambda: lambda texts: [[ord(c) for c in t] for t in texts]
    got = {r.sequence: r.ids for r in inference.tokenize(df, "sequence", make, "ids").collect()}
    assert got["AAA"] == [65, 65, 65]


def test_staging_is_cleared(spark):
    staged = staging.write_and_read(spark.range(5).toDF("x"), "gone")
    assert staged.count() == 5
    assert staging.clear_staging(spark) >= 1


def test_cohorts_meet_by_subject_and_site(spark):
    """400 samples of one subject a side, 160,000 pairs: only cells of a common site are joined."""
    rng = np.random.default_rng(4)
    samples = spark.range(400).select(F.col("id").alias("sample_idx"), F.when(F.col("id") < 399, "s").otherwise("t").alias("subject_name"))
    sides = [pd.DataFrame({"site": rng.permutation(3000)[:1600], "sample_idx": np.arange(1600) % 400, "v": rng.random(1600)}) for _ in "ab"]
    a, b = (spark.createDataFrame(p) for p in sides)
    subjects = np.where(np.arange(400) < 399, "s", "t")
    want = sides[0].assign(u=subjects[sides[0]["sample_idx"]]).merge(sides[1].assign(u=subjects[sides[1]["sample_idx"]]), on=["u", "site"])
    of_a, of_b = (samples.select("subject_name", F.col("sample_idx").alias(f"sample_idx_{n}")) for n in "ab")
    assert cohort._shared_cells(a, of_a, b, of_b, "site", "v", "subject_name").count() == len(want)
    mae = (want["v_x"] - want["v_y"]).abs().groupby([want["u"], want["sample_idx_x"], want["sample_idx_y"]]).mean().to_dict()
    pairs = cohort.cohort_pairs(samples.withColumn("sample_name", F.lit("x")), samples.withColumn("sample_name", F.lit("y")))
    for got in (cohort.subject_scores(a, samples, b, samples, "site", "v"), cohort.cohort_scores(a, b, pairs, "site", "v")):
        found = {(r["subject_name"], r["sample_idx_a"], r["sample_idx_b"]): r["mae"] for r in got.collect()}
        assert found.keys() == mae.keys() and all(abs(found[k] - mae[k]) < 1e-12 for k in mae)
