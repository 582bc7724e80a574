"""Base windows around sites, cut out of a tiled sequence store.

The store has one row per (chr, tile) and each tile carries the first bases of what follows,
so a window of up to `overlap` bases lies inside the tile of its first base: one equi join and
one `substring` per site, nothing to gather afterwards and no chromosome in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.sequence import count_letter


def tile_sequences(contigs: DataFrame, width: int, overlap: int, chr_: str = "chr", seq: str = "seq") -> DataFrame:
    """(chr, tile, seq, seq_len) rows of `width + overlap` bases from (chr, seq) rows.

    The sequence is cut once by a regular expression (linear in its length); an overlap longer
    than one tile takes several following tiles.
    """
    pieces = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    following = -(-overlap // width)
    cut = contigs.select(chr_, F.length(seq).alias("_len"), pieces.alias("_p"))

    def tile(piece, i):
        rest = F.array_join(F.slice("_p", i + 2, F.lit(following)), "") if following else F.lit("")
        return F.struct(
            i.cast("bigint").alias("tile"),
            F.concat(piece, F.substring(rest, 1, overlap)).alias("seq"),
            F.col("_len").alias("seq_len"),
        )

    # All columns of a tile come out of the generator, so a join behind it cannot compute them again
    # for each site. The outer form keeps Spark from adding a filter that cuts each contig twice.
    return (
        cut.select(chr_, F.explode_outer(F.transform("_p", tile)).alias("_t"))
        .where("_t.tile is not null")
        .select(chr_, "_t.tile", "_t.seq", "_t.seq_len")
    )


def site_windows(
    sites: DataFrame, tiles: DataFrame, width: int, bases: int, chr_: str = "chr", pos: str = "pos"
) -> DataFrame:
    """Add `sequence` (window `[pos - bases/2, pos + bases/2)` padded with N) and `base` at pos.

    The tiles must have the same width and overlap by at least `bases`. A position outside its
    contig gets an empty base, see `is_site_base`.
    """
    half = bases // 2
    start, stop = F.col(pos) - F.lit(half), F.col(pos) + F.lit(half)
    placed = sites.withColumn("_from", F.greatest(start, F.lit(0))).withColumn(
        "_tile", F.floor(F.col("_from") / F.lit(width))
    )
    store = tiles.select(
        F.col("chr").alias(chr_), F.col("tile").alias("_tile"), F.col("seq").alias("_seq"), F.col("seq_len").alias("_len")
    )
    inside = F.col("_tile") * F.lit(width)
    end = F.least(stop, F.col("_len"))
    body = F.substring(
        F.col("_seq"), (F.col("_from") - inside + 1).cast("int"), (end - F.col("_from")).cast("int")
    )
    left = F.repeat(F.lit("N"), (F.col("_from") - start).cast("int"))
    right = F.repeat(F.lit("N"), (stop - end).cast("int"))
    return (
        placed.join(store, [chr_, "_tile"])
        .withColumn("sequence", F.concat(left, body, right))
        .withColumn("base", F.substring(F.col("_seq"), (F.col(pos) - inside + 1).cast("int"), F.lit(1)))
        .drop("_from", "_tile", "_seq", "_len")
    )


def is_site_base(base: str = "base"):
    """The base at a site must be C or G in any case."""
    return F.upper(F.col(base)).isin("C", "G")


def unknown_base_share(windows: DataFrame, chr_: str = "chr", seq: str = "sequence") -> DataFrame:
    """Per chromosome: sites, sites whose window has an N, their share, largest N count."""
    n = count_letter(seq, "N")
    return (
        windows.select(chr_, n.alias("_n"))
        .groupBy(chr_)
        .agg(
            F.count("*").alias("num_sites"),
            F.count(F.when(F.col("_n") > 0, 1)).alias("num_with_n"),
            F.max("_n").alias("max_n"),
        )
        .withColumn("ratio", F.try_divide(F.col("num_with_n"), F.col("num_sites")))
    )


def length_stats(df: DataFrame, length) -> DataFrame:
    """Points, mean, population spread, smallest and largest length, cut to integers."""
    return df.select(length.alias("_l")).agg(
        F.count("*").alias("num_points"),
        F.avg("_l").cast("bigint").alias("mean"),
        F.stddev_pop("_l").cast("bigint").alias("std"),
        F.min("_l").cast("bigint").alias("min"),
        F.max("_l").cast("bigint").alias("max"),
    )
