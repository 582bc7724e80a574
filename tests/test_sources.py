"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sitewise.operators import windows
from sitewise.sources import readers, writers


@pytest.fixture
def matrix(tmp_path):
    path = tmp_path / "me.csv"
    path.write_text(",s1,s2,s3\nchr1_10,0.5,,0.25\nchr1_9e+06,NaN,1.0,0\n")
    return str(path)


def test_matrix_wide(spark, matrix):
    df = readers.read_matrix_csv(spark, matrix)
    assert df.columns == ["key", "s1", "s2", "s3"]
    assert [tuple(r) for r in df.collect()] == [("chr1_10", 0.5, None, 0.25), ("chr1_9e+06", None, 1.0, 0.0)]


def test_matrix_long_equals_wide(spark, matrix):
    got = {(r.key, r["sample"]): r.value for r in readers.read_matrix_long(spark, matrix).collect()}
    assert got == {
        ("chr1_10", "s1"): 0.5, ("chr1_10", "s2"): None, ("chr1_10", "s3"): 0.25,
        ("chr1_9e+06", "s1"): None, ("chr1_9e+06", "s2"): 1.0, ("chr1_9e+06", "s3"): 0.0,
    }


def test_quoted_matrix_and_headers_per_file(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"","s,1","s""2"\n"chr1_5",0.5,"0.25"\n"chr1,6",,1\n')
    q = str(tmp_path / "q.csv")
    long = {(r.key, r["sample"], r.value) for r in readers.read_matrix_long(spark, q).collect()}
    assert long == {("chr1_5", "s,1", 0.5), ("chr1_5", 's"2', 0.25), ("chr1,6", "s,1", None), ("chr1,6", 's"2', 1.0)}
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("key,x,y\nk1,1,2\n")
    (folder / "b.csv").write_text("key,y,z\nk2,3,4\n")
    got = {(r.key, r["sample"], r.value) for r in readers.read_matrix_long(spark, str(folder)).collect()}
    assert got == {("k1", "x", 1.0), ("k1", "y", 2.0), ("k2", "y", 3.0), ("k2", "z", 4.0)}


def test_equal_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    writers.write_equal_shards(spark.range(1005), path, ["id"], 100)
    files = spark.read.parquet(path).withColumn("f", F.input_file_name()).groupBy("f", "shard").count().collect()
    assert sorted(r["count"] for r in files) == [5] + [100] * 10 and len({r["shard"] for r in files}) == 11


def test_a_shard_out_of_several_tasks_is_in_order(spark, tmp_path):
    """Later rows are longer, so their files are larger and are read first; a shard lies in several of them."""
    confs = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "100000"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(8000).withColumn("pad", F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") / 1000).cast("int") + 1))
        writers.write_equal_shards(rows, str(tmp_path / "shards"), ["id"], 3000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    read = spark.read.parquet(str(tmp_path / "shards")).select("shard", F.col("_metadata.row_index").alias("row"), "id")
    assert read.where(F.col("shard") * 3000 + F.col("row") != F.col("id")).count() == 0 and read.count() == 8000


def test_tab_separated_matrix(spark, tmp_path):
    (tmp_path / "ge.tsv").write_text("gene\ts1\ts2\nA;ENSG1\t1\t2.5\n")
    assert [tuple(r) for r in readers.read_matrix_csv(spark, str(tmp_path / "ge.tsv"), "\t").collect()] == [("A;ENSG1", 1.0, 2.5)]
    assert readers.read_matrix_long(spark, str(tmp_path / "ge.tsv"), "\t").count() == 2


def test_na_stays_text(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Sample,Cancer\nx,NA\ny,\n")
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "c.csv")).collect()] == [("x", "NA"), ("y", None)]
    assert readers.read_columns(spark, str(tmp_path / "c.csv"), ["Cancer"], 1).collect()[0][0] == "NA"
    with pytest.raises(ValueError):
        readers.read_any(spark, "file.xlsx")


def test_fasta_and_tiles(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nACGT\nAC\n>chr2\nNNNN\n")
    got = {r.chr: (r.seq, r.seq_len) for r in readers.read_fasta(spark, str(tmp_path / "g.fa")).collect()}
    assert got == {"chr1": ("ACGTAC", 6), "chr2": ("NNNN", 4)}
    tiles = windows.tile_sequences(readers.read_fasta(spark, str(tmp_path / "g.fa")), 4, 2)
    assert sorted((r.chr, r.tile, r.seq) for r in tiles.collect()) == [("chr1", 0, "ACGTAC"), ("chr1", 1, "AC"), ("chr2", 0, "NNNN")]


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(
        '##description\nchr1\tHAVANA\tgene\t11869\t14409\t.\t+\t.\tgene_id "ENSG00000223972.5"; gene_type "lncRNA"; gene_name "DDX11L1";\n'
        'chrY\tX\texon\t1\t9\t.\t-\t.\tgene_id "ENSG2.1_PAR_Y"; gene_type "protein_coding";\n'
    )
    got = readers.read_gtf(spark, str(tmp_path / "a.gtf")).collect()
    assert (got[0].start, got[0].end, got[0].gene_id, got[0].gene_name) == (11868, 14409, "ENSG00000223972.5", "DDX11L1")
    assert (got[1].gene_id, got[1].gene_name, got[1].strand) == ("ENSG2.1_PAR_Y", None, "-")


def test_small_files(spark, tmp_path):
    (tmp_path / "keys.txt").write_text(" chr1_5 \nchr1_7\nchr1_5\n\n")
    assert sorted(r.key for r in readers.read_key_list(spark, str(tmp_path / "keys.txt")).collect()) == ["chr1_5", "chr1_7"]
    (tmp_path / "map.json").write_text(json.dumps({"0": "train", "1": "val"}, indent=2))
    assert sorted(tuple(r) for r in readers.read_json_map(spark, str(tmp_path / "map.json")).collect()) == [(0, "train"), (1, "val")]
    (tmp_path / "runs" / "x").mkdir(parents=True)
    (tmp_path / "runs" / "a.json").write_text('{"mse": 0.5}')
    (tmp_path / "runs" / "x" / "b.json").write_text('{"mse": 0.25, "mae": 1}')
    got = sorted(tuple(r) for r in readers.read_metric_tree(spark, str(tmp_path / "runs")).collect())
    assert got == [("a", "mse", 0.5), ("b", "mae", 1.0), ("b", "mse", 0.25)]
    assert readers.first_shards(["b", "c", "a"], 2) == ["a", "b"]


def test_shards_keep_the_rows(spark, tmp_path):
    df = spark.range(1000).withColumn("split", F.when(F.col("id") % 3 == 0, "val").otherwise("train"))
    writers.write_shards(df, str(tmp_path / "s"), 100, partitions=3)
    sizes = spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 100 and sum(r["count"] for r in sizes) == 1000
    with pytest.raises(Exception):
        writers.write_shards(df, str(tmp_path / "s"), 100)
    writers.write_shards(spark.range(3), str(tmp_path / "s"), 100, mode="skip")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1000
    writers.write_split_dataset(df, str(tmp_path / "p"), ["split"])
    assert {p.name for p in (tmp_path / "p").glob("split=*")} == {"split=train", "split=val"}
    writers.write_shuffled(df, str(tmp_path / "sh"), F.xxhash64("id"), 4)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "sh")).collect()) == list(range(1000))
    writers.write_sorted_by_id(df, str(tmp_path / "i"), "id")
    assert spark.read.parquet(str(tmp_path / "i")).where("id = 77").count() == 1


def test_null_twins_tracks_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    writers.write_null_twins(df, str(tmp_path / "n"), "v")
    assert {p.name for p in (tmp_path / "n").glob("is_null=*")} == {"is_null=true", "is_null=false"}
    lines = spark.createDataFrame([("t1", "chr1", 5, "chr1\t5\t6\t0.5"), ("t2", "chr1", 3, "x")], "tissue_name string, chr string, pos int, line string")
    writers.write_tracks(lines, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t" / "tissue_name=t1")).first()["value"] == "chr1\t5\t6\t0.5"
    for form in ("csv", "tsv", "json"):
        writers.write_summary(df, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert writers.markdown(spark.createDataFrame([("x", 1234567)], "name string, n bigint")).endswith("| x | 1,234,567 |\n")
    with pytest.raises(ValueError):
        writers.markdown(spark.range(5), max_rows=4)
    writers.write_violations(df, str(tmp_path / "bad"))
