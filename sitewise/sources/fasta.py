"""FASTA text to sequence tiles by way of its lines.

A contig is never a row. Each task streams the lines of its file blocks twice. The first pass only counts:
one row for each stretch of a contig in a block gives the bases that a contig has in earlier blocks. The
second pass gives each line its place, by a running sum that starts anew at each header, so no line is
shuffled for it. Consecutive lines are joined to pieces of tiles where they are read; a tile is put
together from the few pieces that touch it, which is the one shuffle of the bases.

An unpacked file is read by as many tasks as it has blocks (`spark.sql.files.maxPartitionBytes`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.operators.staging import write_and_read


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, is_head, value, bases) of each line, in the order of the blocks."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    is_head = F.col("value").startswith(">")
    bases = F.when(is_head, "").otherwise(F.regexp_replace("value", "\\s", ""))
    return lines.select("file", "block", is_head.alias("is_head"), "value", bases.alias("bases"))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _count_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, nth, chr, bases) of each stretch of lines of one contig in a block; nth is 0 before the
    block's first header. The lines of a block come one after the other; a stretch that goes on in the next
    batch gives a row there too."""
    last, nth = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").dictionary_encode(), _numbers(batch, "block")
        code, head, size = file.indices.to_numpy(), _numbers(batch, "is_head"), _numbers(batch, "size")
        new = np.ones(len(block), bool)
        new[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        new[0] = last != (file[0].as_py(), int(block[0]))
        first = np.flatnonzero(new | head)
        first = first if len(first) and first[0] == 0 else np.append(0, first)
        numbers = []
        for i in first.tolist():
            nth = (0 if new[i] else nth) + int(head[i])
            numbers.append(nth)
        last = (file[len(file) - 1].as_py(), int(block[-1]))
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("file").take(at), batch.column("block").take(at), pa.array(numbers, pa.int64()), batch.column("chr").take(at),
             pa.array(np.add.reduceat(size, first), pa.int64())],
            ["file", "block", "nth", "chr", "bases"],
        )


def _place_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(contig, at, bases) of each line with bases. `no` numbers the blocks, a contig is the number of its
    header's block and of the header in it; lines before a block's first header go on with what is carried."""
    last, nth, sofar = -1, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        no, head, size = _numbers(batch, "no"), _numbers(batch, "is_head"), _numbers(batch, "size")
        new = np.ones(len(no), bool)
        new[1:], new[0] = no[1:] != no[:-1], no[0] != last
        if new[0]:
            nth, sofar = 0, 0
        heads = np.cumsum(head)
        start = np.maximum.accumulate(np.where(new, np.arange(len(no)), 0))  # of the line's block in this batch
        count = heads - (heads - head)[start] + np.where(np.cumsum(new) == new[0], nth, 0)
        before = np.cumsum(size) - size
        origin = np.maximum.accumulate(np.where(new | head, np.arange(len(no)), -1))
        at = np.where(origin < 0, sofar + before, before - before[np.maximum(origin, 0)])
        own = count > 0
        contig = np.where(own, (no << 40) + count, _numbers(batch, "carry_contig"))
        at = np.where(own, at, at + _numbers(batch, "carry_at"))
        kept = (size > 0) & (contig >= 0)
        last, nth = int(no[-1]), int(count[-1])
        sofar = int(at[-1] + size[-1]) if own[-1] else int(at[-1] + size[-1] - _numbers(batch, "carry_at")[-1])
        made = pa.RecordBatch.from_arrays([pa.array(contig), pa.array(at), batch.column("bases")], ["contig", "at", "bases"])
        yield made.filter(pa.array(kept))


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lines (contig, at, bases) and the contigs (contig, chr, seq_len) of FASTA files.

    Both come from one look at the sizes of stretches, one row per contig and block.
    """
    lines = _lines(spark, path)
    name = F.element_at(F.split(F.substring("value", 2, 1 << 30), "\\s"), 1)
    sizes = lines.select("file", "block", "is_head", F.when(F.col("is_head"), name).alias("chr"), F.length("bases").cast("bigint").alias("size"))
    counted = sizes.mapInArrow(_count_stretches, "file string, block bigint, nth bigint, chr string, bases bigint")
    stretches = write_and_read(counted.groupBy("file", "block", "nth").agg(F.max("chr").alias("chr"), F.sum("bases").alias("bases")), "stretches")

    # One row per block: its number, its last contig, and the bases it has of that contig.
    end = F.max_by(F.struct("nth", "bases"), "nth").alias("end")
    ends = stretches.groupBy("file", "block").agg(end).select("file", "block", "end.*")
    ends = ends.withColumn("no", (F.row_number().over(Window.orderBy("file", "block")) - 1).cast("bigint"))
    file = Window.partitionBy("file").orderBy("block")
    ends = ends.withColumn("run", F.count(F.when(F.col("nth") > 0, 1)).over(file))
    run = Window.partitionBy("file", "run").orderBy("block")
    own = F.when(F.col("nth") > 0, F.shiftleft("no", 40) + F.col("nth"))
    ends = ends.select("file", "block", "no", F.first(own).over(run).alias("c"), F.sum("bases").over(run).alias("so_far"))
    carry = F.lag(F.struct("c", "so_far")).over(file)
    blocks = ends.withColumn("carry", carry).select(
        "file", "block", "no", F.coalesce("carry.c", F.lit(-1)).alias("carry_contig"), F.coalesce("carry.so_far", F.lit(0)).alias("carry_at")
    )
    blocks = write_and_read(blocks, "blocks")

    # The table of blocks is broadcast: it has one row per file block.
    known = lines.select("file", "block", "is_head", "bases", F.length("bases").cast("bigint").alias("size")).join(F.broadcast(blocks), ["file", "block"])
    placed = known.select("no", "is_head", "size", "carry_contig", "carry_at", "bases").mapInArrow(_place_lines, "contig bigint, at bigint, bases string")
    contig = F.when(F.col("nth") > 0, F.shiftleft("no", 40) + F.col("nth")).otherwise(F.col("carry_contig"))
    parts = stretches.join(F.broadcast(blocks), ["file", "block"]).select(contig.alias("contig"), "chr", "bases").where("contig >= 0")
    contigs = parts.groupBy("contig").agg(F.max("chr").alias("chr"), F.sum("bases").alias("seq_len")).where("seq_len > 0")
    return placed, contigs


def contig_lines(spark: SparkSession, path: str) -> DataFrame:
    """(contig, chr, at, bases): each line of bases with its 0-based place in its contig.

    `contig` numbers the headers of the read, so two contigs of one name stay apart. Lines before the
    first header of a file belong to no contig and are left out, as are empty lines.
    """
    placed, contigs = _placed(spark, path)
    return placed.join(contigs.select("contig", "chr"), "contig").select("contig", "chr", "at", "bases")


def contig_sizes(lines: DataFrame) -> DataFrame:
    """(contig, chr, seq_len) of the contigs that have bases."""
    return lines.groupBy("contig").agg(F.first("chr").alias("chr"), F.sum(F.length("bases").cast("bigint")).alias("seq_len"))


def _cut_pieces(width: int, overlap: int):
    """Pieces (contig, tile, at, piece) of the tiles that lines touch; lines that follow each other are one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contig, at, bases = _numbers(batch, "contig"), _numbers(batch, "at"), batch.column("bases").to_pylist()
            if not len(at):
                continue
            size = np.fromiter(map(len, bases), np.int64, len(bases))
            first = np.flatnonzero(np.append(True, (contig[1:] != contig[:-1]) | (at[1:] != at[:-1] + size[:-1])))
            out: list[list] = [[], [], [], []]
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                text, low = "".join(bases[a:b]), int(at[a])
                stop, number = low + len(text), int(contig[a])
                for tile in range(max(low - overlap, 0) // width, (stop - 1) // width + 1):
                    begin, end = max(low, tile * width), min(stop, tile * width + width + overlap)
                    if begin < end:
                        for column, v in zip(out, (number, tile, begin, text[begin - low : end - low]), strict=True):
                            column.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["contig", "tile", "at", "piece"])

    return run


def _tiles(placed: DataFrame, width: int, overlap: int) -> DataFrame:
    """(contig, tile, seq) of lines (contig, at, bases)."""
    pieces = placed.select("contig", "at", "bases").mapInArrow(_cut_pieces(width, overlap), "contig bigint, tile bigint, at bigint, piece string")
    # Dealt before they are gathered: nearly every tile is one piece, so gathering in the map tasks only sorts.
    gathered = pieces.repartition("contig", "tile").groupBy("contig", "tile")
    gathered = gathered.agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return gathered.select("contig", "tile", F.array_join("pieces.piece", "").alias("seq"))


def _tile_names(contigs: DataFrame, width: int) -> DataFrame:
    """(contig, tile, chr, seq_len): a slim row for each tile, so that tiles need not move to their contig."""
    numbers = F.sequence(F.lit(0).cast("bigint"), _floor_div(F.col("seq_len") - 1, width))
    return contigs.select("contig", "chr", "seq_len", F.explode(numbers).alias("tile"))


def tile_lines(lines: DataFrame, width: int, overlap: int) -> DataFrame:
    """(contig, chr, tile, seq): `width + overlap` bases of each tile, put together from its lines.

    A line is cut where tiles begin and end, so a piece belongs to its tile whole; a tile gathers at
    most `width + overlap` bases. Lines longer than a tile are cut in time linear in their length.
    """
    names = lines.groupBy("contig").agg(F.first("chr").alias("chr"))
    return _tiles(lines, width, overlap).join(names, "contig").select("contig", "chr", "tile", "seq")


def read_fasta_tiles(spark: SparkSession, path: str, width: int, overlap: int) -> DataFrame:
    """The tile store of a FASTA file: (chr, tile, seq, seq_len), as `windows.tile_sequences` makes it of contigs."""
    placed, contigs = _placed(spark, path)
    tiles = _tiles(placed, width, overlap).join(_tile_names(contigs, width), ["contig", "tile"])
    return tiles.select("chr", "tile", "seq", "seq_len")


def write_fasta(df: DataFrame, path: str, width: int = 60, chr_: str = "chr", seq: str = "seq", mode: str = "errorifexists"):
    """FASTA files with lines of `width` bases; a contig stays in one file, its lines in order."""
    lines = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    df.select(F.explode(F.concat(F.array(F.concat(F.lit(">"), F.col(chr_))), lines)).alias("value")).write.mode(mode).text(path)
