"""Tiles from the lines of FASTA files: blocks that cut contigs anywhere, odd lines, one large contig."""

import random

import numpy as np
import pytest

from sitewise.operators import windows
from sitewise.sources import fasta


@pytest.fixture
def blocks_of(spark):
    """Sets the size of file blocks for a test."""
    name = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(name), spark.conf.get("spark.sql.files.openCostInBytes")

    def put(size: int) -> None:
        spark.conf.set(name, str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield put
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def tiles_of(contigs, width, overlap):
    return sorted((c, t, s[t * width : t * width + width + overlap], len(s)) for c, s in contigs for t in range(-(-len(s) // width)))


@pytest.mark.parametrize("block", [32, 97, 10_000])
@pytest.mark.parametrize("width,overlap", [(16, 5), (7, 0), (8, 30)])
def test_tiles_of_odd_files(spark, tmp_path, blocks_of, block, width, overlap):
    rng = random.Random(block * width)
    base = lambda n: "".join(rng.choice("acgtACGTN") for _ in range(n))
    contigs, texts = [], []
    for f in range(3):
        text = "before any header\n\n" if f == 1 else ""
        for c in range(6):
            seq = base(rng.choice([0, 1, 15, 16, 17, 200, 333]))
            wrap = rng.choice([1, 10, 60, 1000])
            end = rng.choice(["\n", "\r\n", "\n\n", " \n"])
            name = "twice" if c == 5 else f"c{f}{c}"
            text += f">{name} some text > of it{end}" + "".join(seq[i : i + wrap] + end for i in range(0, len(seq), wrap))
            contigs += [(name, seq)] if seq else []
        texts.append(text + (">last" if f == 2 else ""))
    for f, text in enumerate(texts):
        (tmp_path / f"{f}.fa").write_bytes(text.encode())
    blocks_of(block)
    lines = fasta.contig_lines(spark, str(tmp_path))
    got = [tuple(r) for r in fasta.tile_lines(lines, width, overlap).join(fasta.contig_sizes(lines).select("contig", "seq_len"), "contig").select("chr", "tile", "seq", "seq_len").collect()]
    assert sorted(got) == tiles_of(contigs, width, overlap)
    assert sorted((r["chr"], r["seq_len"]) for r in fasta.contig_sizes(lines).collect()) == sorted((c, len(s)) for c, s in contigs)
    empty = tmp_path / "none.fa"
    empty.write_text("")
    assert fasta.read_fasta_tiles(spark, str(empty), width, overlap).collect() == []


def test_one_large_contig_is_tiled_by_many_tasks(spark, tmp_path, blocks_of):
    n, wrap, width, overlap = 50_000_000, 60, 65_536, 2_400
    codes = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(1).integers(0, 4, n)]
    rows = codes[: n // wrap * wrap].reshape(-1, wrap)
    path = tmp_path / "large.fa"
    with open(path, "wb") as out:
        out.write(b">big\n")
        np.hstack([rows, np.full((len(rows), 1), 10, np.uint8)]).tofile(out)
        out.write(codes[n // wrap * wrap :].tobytes() + b"\n")
    seq = codes.tobytes().decode()
    blocks_of(4 << 20)
    assert spark.read.text(str(path)).rdd.getNumPartitions() >= 8
    tiles = fasta.read_fasta_tiles(spark, str(path), width, overlap).cache()
    found = {r["tile"]: (r["seq"], r["seq_len"]) for r in tiles.collect()}
    assert len(found) == -(-n // width)
    assert all(found[t] == (seq[t * width : t * width + width + overlap], n) for t in found)
    places = [0, 5, 1199, 1200, width - 1, width, width * 9 + 17, n // 2, n - 1200, n - 1]
    sites = spark.createDataFrame([("big", p) for p in places], "chr string, pos long")
    for r in windows.site_windows(sites, tiles, width, overlap).collect():
        low, high = r["pos"] - overlap // 2, r["pos"] + overlap // 2
        want = "N" * max(0, -low) + seq[max(0, low) : min(n, high)] + "N" * max(0, high - n)
        assert (r["sequence"], r["base"]) == (want, seq[r["pos"]])
    tiles.unpersist()


def test_written_fasta_reads_back(spark, tmp_path):
    contigs = [("a", "ACGT" * 40), ("b", "N"), ("c", "acg" * 333)]
    fasta.write_fasta(spark.createDataFrame(contigs, "chr string, seq string").repartition(2), str(tmp_path / "out"), width=50)
    made = fasta.read_fasta_tiles(spark, str(tmp_path / "out"), 64, 10)
    assert sorted(tuple(r) for r in made.collect()) == tiles_of(contigs, 64, 10)


def test_lines_get_their_places_without_a_shuffle(spark, tmp_path):
    """The bases move once, when tiles gather their pieces; of the lines only sizes are shuffled before."""
    contigs = [("a", "ACGT" * 40), ("b", "acg" * 333)]
    fasta.write_fasta(spark.createDataFrame(contigs, "chr string, seq string").repartition(2), str(tmp_path / "out"))
    placed, _ = fasta._placed(spark, str(tmp_path / "out"))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" in plan and "hashpartitioning" not in plan and "Window" not in plan
