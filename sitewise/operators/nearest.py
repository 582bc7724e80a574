"""The k nearest genes of each site on its chromosome.

Neither side is crossed with the other and nothing is repeated with growing radius. Genes are
numbered along the chromosome and kept in overlapping blocks of consecutive numbers; a site
needs the one block its own place falls in, so one equi join on (chr, block) delivers a short
array that surely holds the k nearest genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewise.operators.ranking import ranked


def genes_before(sites: DataFrame, genes: DataFrame, tile: int = 4096) -> DataFrame:
    """(chr, pos, before): genes at or left of each distinct site position.

    Counts run inside tiles and over tile totals. Positions are integers and summed up first, so
    a tile has at most `tile` rows and a chromosome at most its length / tile totals.
    """
    points = (
        genes.select("chr", F.col("gene_pos").alias("pos"), F.lit(1).alias("_g"), F.lit(0).alias("_s"))
        .unionByName(sites.select("chr", "pos", F.lit(0).alias("_g"), F.lit(1).alias("_s")))
        .groupBy("chr", "pos")
        .agg(F.sum("_g").alias("_g"), F.max("_s").alias("_s"))
        .withColumn("_tile", F.floor(F.col("pos") / F.lit(tile)))
    )
    inside = Window.partitionBy("chr", "_tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("chr").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        points.groupBy("chr", "_tile")
        .agg(F.sum("_g").alias("_n"))
        .select("chr", "_tile", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    )
    return (
        points.withColumn("_in", F.sum("_g").over(inside))
        .where("_s = 1")
        .join(totals, ["chr", "_tile"])
        .select("chr", "pos", (F.col("_base") + F.col("_in")).alias("before"))
    )


def gene_blocks(genes: DataFrame, k: int) -> DataFrame:
    """(chr, block, left_genes, right_genes) with at most 2k genes in each array.

    Block b serves places bk .. bk+k-1. Its left array holds the genes numbered from (b-1)k on,
    its right array those from bk on. Equal positions are numbered so that on either side the
    smaller id counts as nearer: right numbers ascend by id, left numbers descend.
    """
    numbered = ranked(genes.select("chr", "gene_pos", "gene_idx"), ["chr"], ["gene_pos", "gene_idx"], "_right")
    ends = numbered.groupBy("chr", "gene_pos").agg((F.min("_right") + F.max("_right")).alias("_ends"))
    numbered = numbered.join(ends, ["chr", "gene_pos"]).withColumn("_left", F.col("_ends") - F.col("_right"))
    left_block, right_block = F.floor(F.col("_left") / F.lit(k)), F.floor(F.col("_right") / F.lit(k))
    uses = F.explode(
        F.array(
            F.struct(left_block.alias("block"), F.lit(True).alias("left")),
            F.struct((left_block + 1).alias("block"), F.lit(True).alias("left")),
            F.struct(right_block.alias("block"), F.lit(False).alias("left")),
            F.struct((right_block - 1).alias("block"), F.lit(False).alias("left")),
        )
    )
    gene = F.struct("gene_pos", "gene_idx")
    return (
        numbered.select("chr", "gene_pos", "gene_idx", uses.alias("_u"))
        .where("_u.block >= 0")
        .groupBy("chr", "_u.block")
        .agg(
            F.collect_list(F.when(F.col("_u.left"), gene)).alias("left_genes"),
            F.collect_list(F.when(~F.col("_u.left"), gene)).alias("right_genes"),
        )
    )


def nearest_genes(sites: DataFrame, genes: DataFrame, k: int) -> DataFrame:
    """Rows (site columns, gene_idx, gene_pos, distance, place); ties go to the smaller gene id."""
    before = genes_before(sites, genes).withColumn("block", F.floor(F.col("before") / F.lit(k)))
    blocks = gene_blocks(genes, k)
    pos = F.col("pos")
    near = F.concat(
        F.filter("left_genes", lambda g: g["gene_pos"] <= pos), F.filter("right_genes", lambda g: g["gene_pos"] > pos)
    )
    keyed = F.transform(
        near,
        lambda g: F.struct(
            F.abs(g["gene_pos"] - pos).alias("distance"), g["gene_idx"].alias("gene_idx"), g["gene_pos"].alias("gene_pos")
        ),
    )
    return (
        sites.join(before, ["chr", "pos"])
        .join(blocks, ["chr", "block"])
        .select(*sites.columns, F.posexplode(F.slice(F.array_sort(keyed), 1, k)).alias("place", "_g"))
        .select(*sites.columns, "_g.gene_idx", "_g.gene_pos", "_g.distance", "place")
    )


def relative_positions(genes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Gene position as a share of the chromosome length."""
    return genes.join(lengths.select("chr", "seq_len"), "chr").withColumn(
        "pos_ratio", F.try_divide(F.col("gene_pos"), F.col("seq_len"))
    )
