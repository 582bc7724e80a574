"""Bucketed tables, lookups, sources that take turns, and records with line breaks."""

import csv
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from sitewise.operators import layout, reshape
from sitewise.operators.store import write_bucketed
from sitewise.plans import exports
from sitewise.sources import readers, writers

SF = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_joins_with_a_bucketed_table_move_the_other_side_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sites = spark.range(500).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("seq"))
        pairs = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
        store = write_bucketed(sites, "k")
        joined = pairs.join(store, "k")
        assert plan_of(joined).count("Exchange hashpartitioning") == 1
        assert joined.count() == sum(i % 700 < 500 for i in range(3000))
        other = write_bucketed(sites.select("k", F.length("seq").alias("n")), "k")
        assert "Exchange hashpartitioning" not in plan_of(store.join(other, "k"))
        assert store.join(other, "k").count() == 500
        assert write_bucketed(sites.limit(0), "k").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_export_joins_sites_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(exports.export_pairs(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line)[0])
    above = [lines[scan]]
    for line in reversed(lines[:scan]):
        if depth(line) < depth(above[-1]):
            above.append(line)
    join = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in above[:join])


@pytest.mark.parametrize("query", ["export_pairs", "four_way_split"])
def test_pairs_are_dealt_by_their_number_not_by_split(spark, query, monkeypatch):
    """Dealt by the names of splits, all pairs would lie in four tasks at any size."""
    from sitewise.plans import registry

    want = sorted(map(str, registry.QUERIES[query](spark, SF).collect()))
    monkeypatch.setattr(layout, "TASK_ROWS", 200)
    tasks = layout.row_tasks(spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert tasks >= 25
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = registry.QUERIES[query](spark, SF)
        plan = plan_of(frame)
        assert sorted(map(str, frame.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(split" not in plan
    top = re.findall(r"hashpartitioning\((?:cpg|sample)_idx#\d+L?, (\d+)\)", plan)
    assert top.count(str(tasks)) >= 3


def scanned(frame) -> int:
    """Rows that the parquet scans of a frame hand on when it runs."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    nodes, rows = [plan], 0
    while nodes:
        node = nodes.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().get("numOutputRows").get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_lookups_read_one_place(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(F.col("id").alias("idx"), F.md5(F.col("id").cast("string")).alias("name"), (F.col("id") * 3).alias("v"))
    path = str(tmp_path / "lookup")
    writers.write_lookup(rows.repartition(5), path, "idx", ["name"], rows_per_group=10_000)
    store = spark.read.parquet(path)
    by_id = store.where("idx = 77777").select("v")
    assert by_id.first()["v"] == 233331 and scanned(by_id) <= 10_000
    name = store.where("idx = 1234").first()["name"]
    by_name = store.where(F.col("name") == name).select("idx")
    assert by_name.first()["idx"] == 1234 and scanned(by_name) <= 30_000
    assert scanned(store.where(F.col("name") == "no such name").select("idx")) <= 20_000
    assert scanned(store.select("v")) == n


def plain_turns(rows, batch):
    """Sources take turns; one that has run out is passed over."""
    queues = {}
    for source, key in sorted(rows):
        queues.setdefault(source, []).append(key)
    out, turn = [], 0
    while len(out) < len(rows):
        for source in sorted(queues):
            out += [(source, k) for k in queues[source][turn * batch : (turn + 1) * batch]]
        turn += 1
    return out


@pytest.mark.parametrize("batch", [1, 4, 50])
def test_sources_take_turns(spark, tmp_path, batch):
    rng = random.Random(batch)
    rows = [(s, k) for s, n in ((0, 37), (3, 1), (4, 90), (9, 12)) for k in rng.sample(range(1000), n)]
    frame = spark.createDataFrame(rows, "source int, key int")
    placed = {r["place"]: (r["source"], r["key"]) for r in reshape.interleave(frame, "source", ["key"], batch).collect()}
    assert [placed[i] for i in range(len(rows))] == plain_turns(rows, batch)
    assert reshape.interleave(frame.limit(0), "source", ["key"], batch).collect() == []
    writers.write_interleaved(frame, str(tmp_path / "out"), "source", ["key"], batch, 2 * batch)
    made = spark.read.parquet(str(tmp_path / "out"))
    sizes = {r["shard"]: r["count"] for r in made.groupBy("shard").count().collect()}
    whole = len(rows) // (2 * batch)
    assert all(sizes[i] == 2 * batch for i in range(whole)) and sum(sizes.values()) == len(rows)
    with pytest.raises(ValueError):
        writers.write_interleaved(frame, str(tmp_path / "odd"), "source", ["key"], 4, 6)


@pytest.mark.parametrize("block", [24, 100, 100_000])
def test_quoted_line_breaks_in_split_files(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for f in range(2):
        names = ["", 'a "b"', "two\nlines", "c,d"][: 3 + f]
        out = io.StringIO()
        write = csv.writer(out, lineterminator="\n")
        write.writerow(names)
        for i in range(40):
            key = rng.choice(["plain", "with\nbreak", 'q "uo" te\n\n', ",", '""', "x" * 90 + "\n" + "y" * 90]) + f"{f}.{i}"
            values = [rng.choice(["", "NaN", "0.5", f"{i}"]) for _ in names[1:]]
            write.writerow([key, *values])
            want += [(key, n, None if v in ("", "NaN") else float(v)) for n, v in zip(names[1:], values)]
        (tmp_path / f"{f}.csv").write_text(out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [tuple(r) for r in readers.read_matrix_long(spark, str(tmp_path), line_breaks=True).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(got, key=repr) == sorted(want, key=repr)
