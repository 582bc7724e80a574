"""Tasks over many slim rows hold a bounded number of them, however well the rows compress."""

import os

import pytest

from sitewise.operators import layout
from sitewise.plans import places

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("query", [places.tissue_mean, places.bedgraph_lines])
def test_tasks_grow_with_the_rows(spark, monkeypatch, query):
    monkeypatch.setattr(layout, "TASK_ROWS", 5000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of the tests are broadcast otherwise, the pairs too
    try:
        sizes = query(spark, SF).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(sizes) >= lines // 5000 and max(sizes) < 10000
