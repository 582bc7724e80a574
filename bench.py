"""Wall time of the headline queries: prints one JSON line.

`BENCH_SF_DIR` names the table folder, `BENCH_CPUS` the number of local cores. Each query is run
to the end by the `noop` writer, so every output row is produced: all once cold, in the order of the
list, then all once warm. The SQL of each query is timed in DuckDB on as many threads next to them.
Names given as arguments replace the headline list; `all` runs every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sitewise.plans.registry import ORACLE, QUERIES  # noqa: E402

HEADLINE = [
    "metric_summary", "pcc_by_site", "pcc_by_sample", "pcc_std_table", "loss_by_key", "pcc_quantiles",
    "union_sites", "assign_ids", "attach_ids", "remap_ids", "four_way_split", "split_by_chr", "split_null",
    "reshard_assign", "shuffle_order", "unpivot_matrix", "pivot_matrix", "merge_matrices", "null_map",
    "seq_window", "n_stats", "encode_bases", "split_overlap", "nearest_genes", "quantile_bins", "filter_hvg",
    "bin_mean", "sample_corr", "cohort_pcc", "export_pairs", "export_slim", "batch_predict", "moving_rate",
    "stream_metrics", "stream_dedupe",
]


def duckdb_times(sf_dir: str, cpus: str, names: list[str]) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    con.execute(f"set threads = {cpus if cpus.isdigit() else 8}")
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            path = f"{sf_dir}/{file}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{file}") else "")
            con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{path}'")
    times = {}
    for name in names:
        t0 = time.time()
        con.execute(ORACLE[name]).fetchall()
        times[name] = round(time.time() - t0, 3)
    return times


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the engine is not a query: one aggregate over the smallest table.
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    picked = list(QUERIES) if names == ["all"] else names or HEADLINE
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for times in (cold, warm):
        for name in picked:
            t0 = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(cold.values()), 3),
                "unit": "sec",
                "queries": cold,
                "warm": warm,
                "duckdb": duckdb_times(sf_dir, cpus, picked),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
